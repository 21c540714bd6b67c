import hashlib
import random
from functools import partial

import pytest
from tests.llm import brute

from chronopanel.llm import near_dedup, segments, substring_dedup, suffix_dedup


def _digest(data: bytes) -> str:
    return hashlib.sha256(bytes(data)).hexdigest()


def _texts(seed: int = 0, groups: int = 12):
    """Groups of near and exact copies with edits of all sizes, documents that share passages, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé\0") for _ in range(rng.randint(1, 6)))
    texts = ["", " \n ", None, "one", "one", "one two three", "Ä ö", "One two three"]
    shared = [word() for _ in range(60)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(20, 150))]
        texts.append(" ".join(base))
        texts.append(" ".join(base).upper())
        for _ in range(8):
            copy = list(rng.choice([base, copy]) if _ else base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy))
        a = rng.randrange(40)
        texts.append(" ".join([*(word() for _ in range(20)), *shared[a : a + 20], *(word() for _ in range(5))]))
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def rows():
    return _texts()


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)


def test_near_duplicates_match_all_pairs(spark, rows):
    for seed in (0,):
        mine = _texts(seed, 40)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(_frame(spark, mine)).collect()}
        assert found == brute.near_duplicates(mine)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    found = sorted(near_dedup.near_duplicates(_frame(spark, rows)).collect(), key=str)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_dedup.near_duplicates(_frame(spark, rows).limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.keep_first(_frame(spark, rows)).collect()) == [0, 0, 1, 1, 3]


def test_near_duplicates_without_broadcasts_and_with_more_levels(spark, monkeypatch):
    mine = _texts(1, 12)
    for name, most in (("MOST_SENT", 0), ("MOST_ROWS_SENT", 0), ("SMALL", 1)):
        monkeypatch.setattr(near_dedup, name, most)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(_frame(spark, mine)).collect()}
    assert found == brute.near_duplicates(mine)


def test_no_row_is_written_for_a_band_or_shingle_that_is_not_shared(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(200)]
    rows = [[word() for _ in range(60)] for _ in range(100)] + [[word() if rng.random() < 0.06 else w for w in base] for _ in range(20)]
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    written, write = [], near_dedup.write_table

    def counted(df):
        table = write(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(near_dedup, "write_table", counted)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(_frame(spark, rows)).collect()}
    assert found == brute.near_duplicates(rows)
    assert max(written) < 120 * near_dedup.BANDS / 2


def test_repeated_words_match_brute_force(spark, rows):
    out = substring_dedup.without_repeats(_frame(spark, rows)).selectExpr("doc_id", "result.*").collect()
    expected = brute.repeated_words(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, _digest(r.text.encode())) for r in out} == expected
    assert sum(n for _, n, _ in expected.values()) > 1000


def _crowd(rng, n, unit, low, high):
    """Rows around one passage of which each has another part, some of them twice in other company."""
    passage = [unit() for _ in range(high)]
    parts = [passage[rng.randrange(3) : rng.randint(low, high)] for _ in range(n // 2)] * 2
    return [[*(unit() for _ in range(15)), *part, *(unit() for _ in range(15))] for part in parts]


def test_repeated_words_of_crowded_anchors(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(x)) for i, x in enumerate(_crowd(rng, 300, lambda: f"w{rng.randrange(10**6)}", 8, 18))]
    for crowd in (20, 2):
        monkeypatch.setattr(substring_dedup, "find_repeats", partial(segments.find_repeats, shard_bytes=2000, crowd=crowd))
        out = substring_dedup.without_repeats(_frame(spark, rows)).selectExpr("doc_id", "result.*").collect()
        assert {r.doc_id: (r.n_words, r.n_removed, _digest(r.text.encode())) for r in out} == brute.repeated_words(rows)


def test_repeated_bytes_of_crowded_anchors(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(x)) for i, x in enumerate(_crowd(rng, 60, lambda: chr(rng.randrange(0, 200)), 20, 60))]
    for crowd in (10, 1):
        monkeypatch.setattr(suffix_dedup, "find_repeats", lambda docs, kind, index, _, crowd=crowd: segments.find_repeats(docs, kind, index, 2000, crowd))
        out = suffix_dedup.without_repeats(_frame(spark, rows), n=30).selectExpr("doc_id", "result.*").collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, _digest(r.rest)) for r in out} == brute.repeated_bytes(rows, 30)


def test_no_shard_has_more_than_the_crowd_of_an_anchor(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(x)) for i, x in enumerate(_crowd(rng, 400, lambda: f"w{rng.randrange(10**6)}", 8, 18))]
    seen = spark.sparkContext.accumulator(0)

    def index(kind, shard):
        from collections import Counter

        if max(Counter(shard.column("key").to_pylist()).values()) > 5:
            seen.add(1)
        return substring_dedup.earlier_matches(kind, shard)

    docs = _frame(spark, rows).selectExpr("doc_id AS doc", "text AS said")
    found, made = segments.find_repeats(docs, segments.Windows(13, 5, True), index, shard_bytes=1000, crowd=5)
    assert found.count() > 100 and len(made) == 2 and seen.value == 0


def test_removed_bytes_may_be_zero_bytes(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(120):
        base = rng.choice(texts) if texts and rng.random() < 0.5 else ""
        texts.append(base[rng.randrange(len(base) // 2 + 1) :] + "".join(rng.choice(["\0" * rng.randint(1, 250), "ab", "\0x"]) for _ in range(rng.randint(1, 6))))
    rows = list(enumerate(texts))
    out = suffix_dedup.without_repeats(_frame(spark, rows)).selectExpr("doc_id", "result.*").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, _digest(r.rest)) for r in out} == brute.repeated_bytes(rows)


def test_repeated_bytes_match_brute_force(spark, rows):
    doubled = [*rows, (-1, "xy" * 300), (-2, "é" * 150)]
    out = suffix_dedup.without_repeats(_frame(spark, doubled)).selectExpr("doc_id", "result.*").collect()
    expected = brute.repeated_bytes(doubled)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, _digest(r.rest)) for r in out} == expected
    assert sum(n for _, n, _, _ in expected.values()) > 1000


def test_removal_keeps_columns_and_empty_tables(spark, rows):
    docs = _frame(spark, rows).withColumnRenamed("key", "result").withColumn("found", substring_dedup.F.lit(1))
    for remove in (substring_dedup.remove_repeats, suffix_dedup.remove_repeats):
        assert remove(docs).columns == docs.columns
        assert remove(docs).count() == len(rows)
        assert remove(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(40)))] * 2, "doc_id long, text string")
    assert [r.result.n_removed for r in substring_dedup.without_repeats(twice).collect()] == [0, 0]
    assert {r.result.n_removed == r.result.n_bytes for r in suffix_dedup.without_repeats(twice, n=50).collect()} == {True}
