import random
import re

import pyarrow as pa

from spectraframe.llm import _common as C
from spectraframe.llm import icws_minhash as M
from spectraframe.llm import spaced_seeds as S

CJK = "春江潮水连海平海上明月共潮生滟滟随波千万里何处春江无月明江流宛转绕芳甸月照花林皆似霰空里流霜不觉飞汀上白沙看不见"


def said(*texts):
    """Words as text, in lower case."""
    _, starts, ends, offsets = C.Words().spans(pa.array(texts, pa.string()))
    raw = "".join(texts).lower().encode()
    words = [raw[a:b].decode() for a, b in zip(starts, ends)]
    return [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def test_words_of_code_points():
    assert said("“Quoted”—a b… don’t", "Ünï_9 naïve", "ét") == [["quoted", "a", "b", "don", "t"], ["ünï_9", "naïve"], ["ét"]]
    assert said("日本語、テスト。", "x中y", "", "สวัสดี", "한국어 말", "🙂", "𠀀𠀁") == [list("日本語テスト"), ["x", "中", "y"], [], list("สวัสดี"), ["한국어", "말"], [], ["𠀀", "𠀁"]]
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abZ_09 .,-éßÑжя—“” €。") for _ in range(60)) for _ in range(50)]
    assert said(*texts) == [re.findall(r"\w+", t.lower()) for t in texts]


def test_typographic_and_unspaced_copies(spark):
    plain = "it is said that one who looks for the long road home - at last - finds the \"old\" gate by the mill"
    typed = plain.replace(" - ", "—").replace("\"old\"", "“old”").replace(" road ", " road ")
    long = CJK * 3
    edited = long[:70] + "一" + long[71:]
    docs = spark.createDataFrame([(1, plain), (2, typed), (3, long), (4, edited), (5, "，".join([CJK[:20], CJK[20:40]]))], "doc_id long, text string")
    classes = {r.doc_id: r.component_id for r in M.near_duplicates(docs).collect()}
    assert (classes[2], classes[4], classes[5]) == (1, 3, 5)
    items = spark.createDataFrame([(7, plain), (8, CJK[:30]), (9, CJK[10:16])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in S.overlaps(docs, items).collect()}
    assert got == {(1, 7), (2, 7), (3, 8), (4, 8), (5, 8), (3, 9), (4, 9), (5, 9)}
