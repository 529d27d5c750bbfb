"""Quality measures against plain Python."""

import os
import random
import re
from collections import Counter

import pytest

from newstide.llm import quality

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y\nx y\n\n x y\n \nx y", "é ß K # $ <b>", "a b c d a b c d e a b c", "\x0b\x0ca\tb\rc"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def histograms(text):
    counts = [len(re.findall(c, text)) for c in quality.CLASSES]
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    known = Counter(w for w in words if w in set(quality.VOCABULARY))
    return counts + [len(text) - sum(counts)], [known[w] for w in quality.VOCABULARY] + [len(words) - sum(known.values())]


def plain_refs(rows, rules=quality.Rules()):
    """By language (classes, common or None) from rows of (text, lang)."""
    sums = {}
    for text, lang in rows:
        if lang is not None:
            both = histograms(text or "")
            sums[lang] = [list(map(sum, zip(*x, strict=True))) for x in zip(sums[lang], both, strict=True)] if lang in sums else both
    out = {}
    for lang, (c, w) in sums.items():
        if sum(c) >= rules.reference_chars:
            out[lang] = [x / sum(c) for x in c], [x / sum(w) for x in w] if sum(w) and w[-1] / sum(w) <= 1 - rules.reference_share else None
    return out


def check(rows, refs):
    rules = quality.Rules()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text)
        c, w = histograms(r.text or "")
        classes, common = refs.get(r.lang, (None, None))
        near = quality.plain_js_distance(c, classes) if classes else 0.0
        none = [0] * len(quality.VOCABULARY) + [1]
        words = quality.plain_js_distance(w, common) / quality.plain_js_distance(none, common) if common else 0.0
        assert abs(r.class_distance - near) < 1e-7 and abs(r.common_distance - words) < 1e-7
        far = (len(r.text or "") >= rules.class_chars and near > rules.class_limit) or (r.n_words >= rules.common_words and words > rules.common_limit)
        assert r.kept == (not r.base_failed and not far)


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_sample_and_references(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    refs = quality.references(quality.histograms(docs))
    want = plain_refs([(r.text, r.lang) for r in docs.collect()])
    assert set(want) == {"en", "de", "fr", "es"} == {r.lang for r in refs.collect()}
    for r in refs.collect():
        assert r.classes == pytest.approx(want[r.lang][0]) and r.common == pytest.approx(want[r.lang][1])
    check(quality.judge(quality.measure(docs), refs).collect(), want)


def test_odd_texts(spark):
    dice = random.Random(4)
    texts = ODD + [" ".join(dice.choice("abcde") for _ in range(dice.randint(0, 30))) for _ in range(100)] + ["the of and to " * 300, "$$ ## " * 200, "zzz yyy " * 5000]
    rows = [(k, t, ("en", None, "de")[k % 3] if k < 60 else "en", "mine", "a", "b", "c") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, _m string, _c string, row string")
    refs = quality.references(quality.histograms(df))
    out = quality.judge(quality.measure(df), refs)
    assert out.columns[:6] == ["doc_id", "text", "lang", "_m", "_c", "row"] and dict(out.dtypes)["n_words"] == "bigint"
    want = plain_refs([r[1:3] for r in rows])
    assert set(want) == {"en"}
    check(out.collect(), want)
    assert {(r["_m"], r["_c"], r["row"]) for r in out.collect()} == {("a", "b", "c")}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == out.where("kept").count()


def prose(letters, n, dice):
    stock = ["".join(dice.choice(letters) for _ in range(dice.randint(2, 9))) for _ in range(4000)]
    return " ".join(dice.choice(stock) for _ in range(n)) + "."


def test_languages_in_other_scripts_stay(spark):
    """Documents of any language are compared with their own; few of them, or none with a language, pass."""
    dice = random.Random(11)
    scripts = {"ru": "абвгдежзиклмнопрстуфхцчшщыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "th": "กขคงจชซญดตถทธนบปผพฟภมยรลวศสหอฮ", None: "אבגדהוזחטיכלמנסעפצקרשת", "en": "etaoinshrdlu"}
    rows = [(k, prose(letters, 150, dice), lang) for lang, letters in scripts.items() for k in range(60 if lang != "th" else 3)]
    rows.append((0, "§±!? 0198 " * 60 + " ".join(str(dice.random()) for _ in range(100)), "ru"))
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = quality.assess(df).groupBy("lang").agg({"kept": "collect_list"}).collect()
    kept = {r.lang: r[1] for r in got}
    assert all(all(kept[lang]) for lang in ("el", "th", None, "en")) and kept["ru"].count(False) == 1
    assert quality.keep_good(df).count() == len(rows) - 1


def test_nothing_and_no_reference(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.references(quality.histograms(empty)).count() == 0 and quality.assess(empty).count() == 0
    alone = quality.assess(spark.createDataFrame([(1, "w%d " % 1 * 10, None), (2, " ".join(map(str, range(99))), "xx")], "doc_id long, text string, lang string")).collect()
    assert [(r.kept, r.class_distance, r.common_distance) for r in sorted(alone, key=lambda r: r.doc_id)] == [(False, 0.0, 0.0), (True, 0.0, 0.0)]
