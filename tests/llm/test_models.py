from collections import Counter
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontamination, language_id, quality, queries
from tests.llm import corpus

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200}, {"block_bytes": 200, "pass_bytes": 600}])
def test_decontamination(spark, options):
    rows = corpus.texts()
    by = dict(rows)
    items = [("a", by[54]), ("b", "One TWO, three"), ("c", None), ("d", "?!"), ("e", " ".join(by[8].split()[100:111])), ("b", "one"), (None, "ha-ha"), ("f", "never there at all")]
    patterns: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            patterns.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in patterns:
                    found |= patterns[tuple(w[k : k + m])]
                    hit[k : k + m] = [True] * m
        want.append((str(i), len(w), sum(hit), sorted(x for x in found if x is not None)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_contamination(corpus.frame(spark, rows), bench, **options).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], sum(e - s for s, e in zip(r["hit_starts"], r["hit_ends"], strict=True)), r["items"]) for r in got) == sorted(want)
    empty = spark.createDataFrame([], "item_id string, text string")
    assert all(not r["hit_starts"] for r in decontamination.find_contamination(corpus.frame(spark, rows), empty).collect())


def test_suffix_automaton_parses_into_the_fewest_longest_matches():
    r = random.Random(3)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    as_symbols = lambda t: language_id.symbols(pa.array([t]))[0].tobytes()
    known = [as_symbols(text("abc ", r.randint(1, 40))) for _ in range(30)]
    model = language_id.Model({"xx": language_id.SuffixAutomaton(known)})
    substrings = {s[a:b] for s in known for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    texts = [text("abcd ,", r.randint(0, 60)) for _ in range(200)] + [text("ab c", 1500)]
    for t, got in zip(texts, model.totals(pa.array(texts)).tolist(), strict=True):
        whole, phrases = as_symbols(t), 0
        for at in range(0, len(whole), language_id.STRETCH):
            left = whole[at : at + language_id.STRETCH]
            while left:
                n = max((k for k in range(1, len(left) + 1) if left[:k] in substrings), default=1)
                left, phrases = left[n:], phrases + 1
        assert got == [len(whole), phrases]


def test_symbols_are_words_with_a_blank_before_each():
    texts = ["One, two!", None, "", "12 ?", "Über-Ähre 3x", "a"]
    data, off = language_id.symbols(pa.array(texts))
    assert [data[off[i] : off[i + 1]].tobytes().decode() for i in range(len(texts))] == [" one two", "", "", "", " über ähre x", " a"]


def test_automaton_of_a_large_alphabet_is_small():
    r = random.Random(5)
    text = "".join(chr(0x4E00 + r.randrange(4000)) for _ in range(40_000)).encode()
    assert language_id.SuffixAutomaton([text]).nbytes() < 50 << 20


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op3_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang_pred = lang").count() / out.count() > 0.95
    odd = corpus.frame(spark, [(1, None), (2, ""), (3, "12 34 !?"), (None, "die der und"), (5, "x" * 100_000)])
    model = language_id.learn(docs, sample_rows=50)
    got = {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert got["1"] == got["2"] == got["3"] == ("und", 0.0) and got["None"][0] == "de" and 0 <= got["5"][1] <= 1
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.learn(docs.where("lang is null"))).collect()} == {"und"}
    assert language_id.identify(corpus.frame(spark, []), model).count() == 0


def test_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.op1_quality(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    held = out.where("held_out").join(labels, "doc_id")
    assert held.where(F.col("predicted") == F.col("quality")).count() / held.count() > 0.9
    odd = quality.describe(corpus.frame(spark))
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    assert quality.score(odd, quality.learn(odd, both)).where("score is null or isnan(score)").count() == 0
    assert {r["score"] for r in quality.score(odd, quality.learn(odd, both.where("quality = 1"))).collect()} == {0.5}
    assert quality.describe(corpus.frame(spark, [])).count() == 0


def test_quality_statistics_by_hand(spark):
    """The statistics of every text, counted with plain Python over its bytes."""
    marks = {2: b"abcdefghijklmnopqrstuvwxyz", 3: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4: b"0123456789", 5: b".", 6: b",;:!?'\"()-", 7: b"#$%&*+/<=>@[\\]^_`{|}~", 8: b" \t", 9: b"\n\r"}
    kind = lambda x: next((k for k, held in marks.items() if x in held), 10 if x >= 128 else 1)
    odds = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))

    def by_hand(text):
        raw = (text or "").encode()
        n = Counter(map(kind, raw))
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        threes = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        letters, body = n[2] + n[3] + n[10], len(raw) - n[8] - n[9]
        of = lambda test: odds(sum(map(test, w)), len(w))
        again = sum(a == b for a, b in zip(w, w[1:], strict=False))
        return [
            math.log1p(len(w)), math.log((body + 1) / (len(w) + 1)), math.log1p(n[9]) - math.log1p(len(w)),
            odds(n[3], letters), *[odds(n[k], body) for k in (4, 5, 6, 7, 1, 10)],
            odds(len(set(w)), len(w)), odds(max(Counter(w).values(), default=0), len(w)), odds(len(set(threes)), len(threes)), odds(again, len(w)),
            of(lambda x: kind(x[-1]) == 7), of(lambda x: kind(x[-1]) == 6), of(lambda x: kind(x[0]) == 3), of(lambda x: len(x) <= 2), of(lambda x: not any(kind(b) in (2, 3, 10) for b in x)),
        ]

    rows = corpus.texts() + [(200, "One, two. Three THREE three three! (4) 5.0 #6\r\nÜber\tx\x01y"), (201, "...")]
    got, text = quality.describe(corpus.frame(spark, rows)).collect(), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(r["x"], by_hand(text[r["doc_id"]])), text[r["doc_id"]]


def test_quality_scores_by_hand():
    """Scores from the textbook formula: inverse and determinant of the shrunk covariances, no Cholesky factors."""
    rng = np.random.default_rng(4)
    y = np.arange(300) % 2
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * (1 + y[:, None]) + 0.5 * y[:, None]
    shrinkage = 0.1
    z = (x - x.mean(0)) / x.std(0)
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    target = np.diag(np.diag((cov[0] + cov[1]) / 2))

    def density(k):
        c, d = (1 - shrinkage) * cov[k] + shrinkage * target, z - z[y == k].mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c))

    model = quality._gaussians(x, y, shrinkage)
    assert np.allclose(model.margin(x), density(1) - density(0))
    fitted = quality.fit(x, y, np.arange(300) // 2 % 4)
    assert np.allclose(fitted.score(x), 1 / (1 + np.exp(-(fitted.slope * fitted.margin(x) + fitted.shift)))) and ((fitted.score(x) > 0.5) == y).mean() > 0.7


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_tokens import FILES, reference

    rows = corpus.texts()
    bench = [("a", " ".join(dict(rows)[8].split()[40:60]))]
    docs = corpus.frame(spark, rows)  # with columns whose names clash
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stay = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    best: dict[str, int | None] = {}
    for i, t in stay:
        best[t] = i if t not in best or corpus.smaller(best[t], i) else best[t]
    stay = [(i, t) for i, t in dict.fromkeys(stay) if best[t] == i]
    first = {a for a, _, c in corpus.near_components(stay) if a == c}
    stay = [(i, t) for i, t in stay if str(i) in first]
    pattern = [tuple(words(bench[0][1])[k : k + 10]) for k in range(11)]
    stay = [(i, t) for i, t in stay if not any(tuple(words(t)[k : k + 10]) in pattern for k in range(len(words(t))))]
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(ids) + 1 for (i, _), ids in zip(stay, reference(FILES[0], [t for _, t in stay]), strict=True)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_tells_rows_of_one_doc_id_apart(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_tokens import FILES, reference

    texts = corpus.texts()
    by = dict(texts)
    near = by[54].split()  # 40 words, so one changed at the end leaves 35 of 37 shingles
    copy = lambda w, *end: " ".join([*w[: len(w) - len(end)], *end])
    alone = [by[i] for i in range(60, 66)]
    # 901 and 902: a near copy and a clean text; 903: near copies only; null: near copies only
    rows = texts + [(901, copy(near, "other")), (901, alone[0] + " again"), (902, "a clean text of its own"), (902, copy(near, "third"))]
    rows += [(903, copy(by[70].split(), "one")), (903, copy(by[70].split(), "two")), (903, "nothing like it here"), (903, "nothing like it here")]
    rows += [(None, copy(alone[1].split(), "left")), (None, copy(alone[1].split(), "right"))]
    spark.createDataFrame([("a", "never there at all")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    stay: dict[str, int | None] = {}
    for i, t in rows:
        if any(c.isalpha() for c in t or "") and (t not in stay or corpus.smaller(stay[t], i)):
            stay[t] = i
    order = sorted(stay, key=lambda t: (stay[t] is not None, stay[t] or 0))
    groups: dict[int, list[str]] = {}
    for place, _, c in corpus.near_components(list(enumerate(order))):
        groups.setdefault(int(c), []).append(order[int(place)])
    pools = list(groups.values())
    out = corpus_pipeline.near_duplicates(spark, corpus_pipeline.exact_duplicates(spark, corpus_pipeline.language(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), ""), ""), "").collect()
    assert len(out) == len(pools)
    kept = {r["text"]: r["doc_id"] for r in out}
    for pool in pools:
        (t,) = [t for t in pool if t in kept]
        assert kept[t] == stay[t] and not any(corpus.smaller(stay[u], stay[t]) for u in pool)
    assert kept["a clean text of its own"] == 902 and kept["nothing like it here"] == 903 and sum(i == 50 for i in kept.values()) == 1
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    want: dict = {}
    for (t, i), ids in zip(kept.items(), reference(FILES[0], list(kept)), strict=True):
        want[i] = want.get(i, 0) + len(ids) + 1
    assert got == want


def test_language_stage_keeps_every_text_with_a_letter(spark):
    import corpus_pipeline

    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "one"), (None, "die der und"), (4, "中文"), (5, "Ü"), (5, "7é")]
    docs = corpus.frame(spark, rows)
    want = sorted((str(i), t) for i, t in rows if any(c.isalpha() for c in t or ""))
    for lang in (None, "und", "en"):
        stay = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(lang).cast("string")), "")
        assert sorted((str(r["doc_id"]), r["text"]) for r in stay.collect()) == want, lang


def test_language_id_learns_the_whole_of_a_long_run(spark):
    head = "".join(chr(0x4E00 + k) for k in range(64))
    tails = {"aa": "".join(chr(0x5000 + k) for k in range(100)), "bb": "".join(chr(0x6000 + k) for k in range(100))}
    docs = spark.createDataFrame([(k, head + t, x) for k, (x, t) in enumerate(sorted(tails.items()))], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame([(1, tails["aa"][70:90]), (2, tails["bb"][70:90])], "doc_id long, text string"), model).collect()}
    assert got == {1: "aa", 2: "bb"}


def test_language_stage_names_the_language_of_rows_without_one(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.language(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), "")
    both = out.join(docs.select("doc_id", F.col("lang").alias("was")), "doc_id").where("was is not null")
    assert out.columns == docs.columns and both.where("lang is null").count() == 0
    assert both.where("lang = was").count() / both.count() > 0.95
