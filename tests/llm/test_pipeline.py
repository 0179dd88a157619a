import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline as pipeline
from spectraframe.llm import byte_bpe as B

SF = "/root/testdata/sf0.001"


def test_stages_on_planted_documents(spark, tmp_path):
    rnd = random.Random(5)
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    para = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    item = para(40)
    near = para(400).split()
    copy = list(near)
    copy[200] = "changed"
    line = para(30)
    texts = {
        90001: "\n".join(" ".join(near[i : i + 40]) for i in range(0, 400, 40)),
        90002: "\n".join(" ".join(copy[i : i + 40]) + " tail" + str(i) for i in range(0, 400, 40)),
        90003: para(50) + "\n" + line + "\n" + para(50),
        90004: para(50) + "\n" + line + "\n" + para(50),
        90005: para(60) + " " + item + " " + para(60),
        90006: "BUY!! NOW!! $$$ ### %%% " * 60,
    }
    rows = [(i, t, "en", "planted", len(t)) for i, t in texts.items()]
    folder = str(tmp_path / "sf")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").union(spark.createDataFrame(rows, clean.schema))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == clean.columns
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    good, lines, groups, safe, coded = (kept[n] for n, _ in pipeline.STAGES)
    assert 90006 not in good and {90001, 90003, 90005} <= set(good)
    assert line in lines[90003].text and line not in lines[90004].text and lines[90004].n_chars == len(lines[90004].text)
    assert set(lines) == set(good) and set(groups) <= set(lines)
    assert 90005 in groups and 90005 not in safe and {90003, 90004} <= set(safe)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(B.default_path()), special_tokens={})
    assert set(coded) == set(safe)
    for i, r in coded.items():
        ids = enc.encode_ordinary(safe[i].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(safe[i].text.encode()).hexdigest()


def test_no_stage_breaks_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
