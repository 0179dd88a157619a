import itertools

import corpus_pipeline
from spectraframe.llm import spaced_seeds as S


def planted():
    """Items of 5 to 20 words, and documents that hold one whole, with every set of up to 2 tolerated substitutions."""
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (5, 9, 12, 13, 15, 20)}
    docs, want = [], set()
    for n, words in items.items():
        size = min(n, S.WORDS)
        for gone in itertools.chain(*(itertools.combinations(range(n), k) for k in range(4))):
            if len(gone) == 3 and sum(gone) % 7:
                continue
            d = len(docs)
            docs.append((d, " ".join(["a b c", *("zz" if k in gone else w for k, w in enumerate(words)), "d e f"])))
            if any(sum(p <= k < p + size for k in gone) <= size // 5 for p in range(n - size + 1)):
                want.add((d, n))
    return docs, [(n, " ".join(w)) for n, w in items.items()], want


def test_query_and_pipeline_find_every_tolerated_substitution(spark, tmp_path):
    docs, items, want = planted()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = S.op8_spaced_seeds(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_words >= min(r.item_id, S.WORDS) and 5 * r.n_matches >= 4 * r.n_words for r in got)
    kept = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
