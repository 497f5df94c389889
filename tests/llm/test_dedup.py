import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, ngram_join, packed, run_index, substring_dedup, suffix_dedup
from quadrille.llm.components import components
from quadrille.llm.workspace import Workspace, with_row_key
from tests.llm import corpus


@pytest.mark.parametrize("counters", [2, 4096])
def test_exact_dedup(spark, counters):
    rows = corpus.texts()
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in exact_dedup.exact_dedup(corpus.frame(spark, rows), counters=counters).collect())
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want, stays = [], set()  # of rows that repeat both, one stays
    for i, t in rows:
        kept = i == best[t or ""] and (t or "") not in stays
        stays |= {t or ""} if kept else set()
        want.append((str(i), str(best[t or ""]), len(groups[t or ""]), kept, corpus.sha(t or "")))
    assert got == sorted(want)


def test_misra_gries_keeps_the_frequent():
    import pyarrow as pa

    values = [bytes([i % 50]) for i in range(1000)] + [b"hot"] * 600
    out = list(exact_dedup.misra_gries(iter([pa.record_batch([pa.array(values[k : k + 100], pa.binary())], ["digest"]) for k in range(0, 1600, 100)]), 4))
    found = out[0].to_pylist()
    assert len(found) <= 4 and max(found, key=lambda r: r["seen"])["digest"] == b"hot"


@pytest.mark.parametrize("options", [{}, {"chunk": 3, "bucket_entries": 500, "frequent": 3, "coarse": 4}])
def test_ngram_join_links_what_all_pairs_link(spark, options):
    rows = corpus.texts()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_documents(corpus.frame(spark, rows), **options).collect())
    assert got == corpus.near_components(rows)


def test_frequent_shingles_are_found_in_pairs():
    """All shingles frequent: similar sets still share a signature."""
    rng = np.random.default_rng(1)
    for n in (2, 3, 4, 5, 9, 40, 333):
        for _ in range(20):
            a = np.sort(rng.integers(1, 1 << 63, n).astype(np.uint64))
            b = np.sort(np.concatenate([a[int(np.floor(0.12 * n)) :], rng.integers(1, 1 << 63, int(0.1 * n)).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
                continue
            x, y = (ngram_join.signatures(np.zeros(len(s), np.int64), s, np.full(len(s), 20))[1] for s in (a, b))
            assert len(np.intersect1d(x, y)) or np.array_equal(a, b)


def test_similar_sets_share_a_signature_at_any_level():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 12, 60, 200):
        for _ in range(30):
            a = rng.integers(1, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[int(np.floor(0.12 * n)) :], rng.integers(1, 1 << 63, int(0.1 * n)).astype(np.uint64)])
            both = np.union1d(a, b)
            level = dict(zip(both.tolist(), (1 + rng.integers(0, 14, len(both))).tolist(), strict=True))
            found = []
            for s in (a, b):
                s = np.sort(s)
                mine = np.array([level[x] if np.isin(np.uint64(x), a) and np.isin(np.uint64(x), b) else 0 for x in s.tolist()])
                found.append(ngram_join.signatures(np.zeros(len(s), np.int64), s, mine)[1])
            if 75 * len(both) <= 100 * len(np.intersect1d(a, b)) < 100 * len(both):  # equal sets are one node
                assert len(np.intersect1d(*found))


@pytest.mark.parametrize("options", [{}, {"bucket_entries": 100, "coarse": 4}])
def test_substring_dedup(spark, options):
    rows = corpus.texts()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(corpus.frame(spark, rows), **options).collect())
    assert got == corpus.kept_words(rows)


@pytest.mark.parametrize("options", [{}, {"group": 2, "bucket_anchors": 50, "coarse": 4}, {"gram": 120}])
def test_suffix_dedup(spark, options):
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in corpus.texts()]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(corpus.frame(spark, rows), **options).collect())
    assert got == corpus.kept_bytes(rows)


def test_run_index_classes_are_equal_strings():
    rng = np.random.default_rng(2)
    for _ in range(100):
        segments = [bytes(rng.choice(np.frombuffer(b"ab\0", np.uint8), rng.integers(1, 40)).tobytes()) for _ in range(rng.integers(1, 6))]
        segments += segments[:1]
        data, size = np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments])
        ends, length = np.repeat(np.cumsum(size), size), int(rng.integers(1, 9))
        at, number = run_index.classes(data, ends, length)
        held: dict[int, set] = {}
        for i, k in zip(at, number, strict=True):
            held.setdefault(int(k), set()).add(data[i : i + length].tobytes())
        strings = {data[i : i + length].tobytes() for i in range(len(data)) if ends[i] - i >= length}
        assert all(len(v) == 1 for v in held.values()) and len(held) == len(strings)


def test_row_keys_are_distinct_and_parts_bounded(spark, tmp_path):
    rows = corpus.texts()
    corpus.frame(spark, rows).write.parquet(f"{tmp_path}/docs")
    work = Workspace(spark, "test")
    for docs in (spark.read.parquet(f"{tmp_path}/docs").where("doc_id > 0 or doc_id is null"), corpus.frame(spark, rows)):
        keyed = with_row_key(docs, work, "key")
        first, again = ({r["key"]: r["text"] for r in x.select("key", "text").collect()} for x in (keyed, keyed.repartition(2)))
        assert len(first) == len(rows) and first == again
        size, count = packed.measure(keyed)
        parts: dict[int, list] = {}
        for r in packed.with_part(keyed, "key", size, count, 4096).select("part", F.octet_length("text").alias("n")).collect():
            parts.setdefault(r["part"], []).append(r["n"] or 0)
        assert all(len(v) == 1 or sum(v) <= 4 * 4096 for v in parts.values()) and len(parts) > 3


def test_dealing_twice_keeps_every_entry(spark):
    rng = np.random.default_rng(5)
    part, key = rng.integers(0, 9, 3000), rng.integers(0, 1 << 30, 3000).astype("<u8")
    fine = lambda doc, key: (key % 50).astype(np.int64)
    rows = [r for lo in range(0, 3000, 500) for r in packed.rows_of(packed.coarse_of(fine(None, key[lo : lo + 500]), 50, 4), part[lo : lo + 500], key[lo : lo + 500])]
    out = packed.dealt(spark.createDataFrame(rows, packed.SCHEMA), 50, fine, np.dtype("<u8"), 0, coarse=4).toArrow()
    got = [(int(b), int(p), int(k)) for i, b in enumerate(out["bucket"].to_pylist()) for p, k in zip(*packed.entries(out.slice(i, 1), 0, "<u8"), strict=True)]
    assert sorted(got) == sorted((int(k % 50), int(p), int(k)) for p, k in zip(part, key, strict=True))


def test_ids_that_are_no_integers(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "One  two three"), ("c", None)], "doc_id string, text string")
    assert sorted(tuple(r) for r in ngram_join.similar_documents(docs).collect()) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
    for fn in (substring_dedup.remove_repeats,):
        with pytest.raises(TypeError):
            fn(docs)


def test_rows_without_an_id_are_rows_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, "nothing like it here at all"), (5, text + " more"), (5, "something else altogether for once")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_documents(docs).collect())
    assert got == [("5", 1, "5"), ("5", 57, "5"), ("None", 2, "None"), ("None", 56, "5")]


@pytest.mark.parametrize("one_task", [0, 10, 1000])
def test_components(spark, one_task):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, rng.integers(0, 120, 2))) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)]
    least = {x: x for p in links for x in p}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r["node"]: r["component"] for r in components(Workspace(spark, "test"), df, one_task=one_task).collect()}
    assert got == {a: b for a, b in least.items() if a != b}


def test_empty_tables(spark):
    empty = corpus.frame(spark, [])
    for df in (exact_dedup.exact_dedup(empty), ngram_join.similar_documents(empty), substring_dedup.remove_repeats(empty), suffix_dedup.remove_repeats(empty)):
        assert df.count() == 0
