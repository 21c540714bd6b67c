"""Filter audit, Merkle manifest and best-fit packing against plain versions, on odd rows."""

import random
import re
import zlib
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import best_fit, filter_audit, merkle

CLASHING = ("keys", "print", "class", "n", "low", "salt", "tree", "digest", "rank", "range", "block", "what", "bin", "size", "mask", "number")
WORDS = ["tree", "Stone", "river#", "KLM", "x9", "été", "中", "a"]


def _docs(spark, rows):
    out = spark.createDataFrame([r if len(r) == 5 else (*r, "en", 1) for r in rows], "doc_id long, source string, text string, lang string, n_chars long")
    return out.withColumns({c: F.lit(0) for c in CLASHING}).repartition(3)


def _odd(n=160, seed=1):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 30, 250])))
    base = [text() for _ in range(12)] + ["", None, " \n\t ", "w " * 60_000, "w " * 60_000 + "x", "A" * 70 + "same start, other end", "A" * 70 + "same start, other enD"]
    rows = [(i, rng.choice(["s", "", None, "hot", "hot"]), rng.choice(base)) for i in range(n)]
    return [*rows, rows[3], (rows[5][0], rows[5][1], "other text of the id"), (None, "s", base[0]), (None, None, None), (-5, "t", base[13])]


# ---- filter audit


def _plain_audit(rows, labels):
    low = {}
    for i, _, t in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    of, good, toxic = {}, set(), set()
    for i, q, x in labels:
        if q == 1 and i is not None:
            good.add(i)
        if x == 1 and i is not None:
            toxic.add(i)
    for i, s, t in rows:
        t, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and low[t] < i}
        of.setdefault(s or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, docs in of.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = sum(f in d[0] for d in docs)
                out[part, "".join(order), k] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[f] += len(gone)
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("sent", [filter_audit.MOST_SENT, 0])
def test_audit_is_that_of_every_order_run_by_itself(spark, monkeypatch, sent):
    monkeypatch.setattr(filter_audit, "MOST_SENT", sent)
    monkeypatch.setattr(filter_audit, "PER_SALT", 3)
    rows = _odd()
    labels = [(i, i % 3, i % 2) for i in range(0, 90)] + [(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (7, 1, 1)]
    out = filter_audit.audit(_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in out.collect()} == _plain_audit(rows, labels)
    empty = _docs(spark, rows).limit(0)
    assert filter_audit.audit(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_equal_hashes_of_different_texts_are_compared(spark, monkeypatch):
    rows = [(i, "s", t) for i, t in enumerate(["abc", "abd", "abc", "abd", "abe", "abd", "xyzw"])]
    plain = filter_audit._prints

    def blind(texts):
        return plain(filter_audit.pa.array(["same"] * len(texts)))

    docs = filter_audit._rows(_docs(spark, rows), "doc_id", "text", "source")
    made = filter_audit.with_verdict(docs, blind, ["text"], filter_audit.PRINT, "print")
    assert sorted(r.doc_id for r in filter_audit._marked(made, made.select("doc_id", "print.keys")).collect()) == [2, 3, 5]
    assert sorted(r.doc_id for r in filter_audit.duplicates(_docs(spark, rows)).collect()) == [2, 3, 5]


# ---- merkle manifest


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _tree(nodes):
    """Root, and for each node its path: (left, right) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            a = at[i] // 16 * 16
            run = nodes[a : a + 16]
            p.append(("".join(run[: at[i] - a]), "".join(run[at[i] - a + 1 :])))
        nodes = [_h(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
        at = [x // 16 for x in at]
    return (nodes[0] if nodes else None), paths


def _plain_manifest(rows):
    leaf = lambda r, t: _h(*(_field(x) for x in (r[0], r[1], r[3], r[4], t)))
    of = {}
    for r in rows:
        changed = r[2] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[2]) if changed else r[2]
        of.setdefault("" if r[1] is None else "s" + r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[2]), leaf(r, text)))
    trees = {s: (sorted(x), *_tree([y[2] for y in sorted(x)])) for s, x in of.items()}
    names = sorted(trees, key=str.encode)
    root, above = _tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        leaves, subroot, paths = trees[s]
        for (has, i, mine, now), path in zip(leaves, paths, strict=True):
            for left, right in (path := path + up):
                now = _h(left, now, right)
            out.append((i if has else None, mine, subroot, root, _h(*(a + b for a, b in path)), now, now == root))
    return out


@pytest.mark.parametrize("deep", [1, 2])
def test_manifest_is_that_of_a_plain_walk(spark, deep):
    rows = [(*r, lang, n) for r, lang, n in zip(_odd(), ["en", None, "fr"] * 60, [None, 3] * 90, strict=False)]
    rows += [(i, "big", f"Text {i}", "en", i) for i in range(1000, 1000 + 16 * 16 + 1)] + [(i, f"src{i}", "Alone", "en", 1) for i in range(2000, 2020)]
    docs = _docs(spark, rows)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    mine = [tuple(r) for r in merkle.manifest(docs, deep, tampered).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(mine, key=key) == sorted(_plain_manifest(rows), key=key)
    assert merkle.manifest(docs.limit(0), deep).count() == 0
    one = merkle.manifest(docs.where("source = 'src2003'"), deep).collect()
    assert len(one) == 1 and one[0].verified and one[0].leaf == one[0].root and one[0].proof_sha256 == _h("")


# ---- best-fit packing


def _plain_best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


@pytest.mark.parametrize("kind", ["mixed", "tiny", "same", "large"])
def test_best_fit_is_near_the_sequential_one(spark, monkeypatch, kind):
    monkeypatch.setattr(best_fit, "LAST_MOST", 0 if kind == "mixed" else 100)
    rng = random.Random(5)
    draw = {"mixed": lambda: min(256, int(rng.paretovariate(0.8) * 5)), "tiny": lambda: rng.randint(1, 6), "same": lambda: 100, "large": lambda: rng.randint(90, 256)}[kind]
    lengths = [draw() for _ in range(1500)]
    pieces = spark.createDataFrame([(i // 2, i % 2, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    rows = best_fit.best_fit(pieces, 256).collect()
    assert sorted((r.ids_crc32, r.length) for r in rows) == list(enumerate(lengths))
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in of.values():
        places.sort()
        assert [a for a, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1]) and sum(n for _, n in places) <= 256
    assert len(of) <= 1.03 * _plain_best_fit(lengths, 256) + 2


def test_the_last_documents_go_by_sequential_best_fit():
    rng = random.Random(8)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 60))]
        of = {}
        for n, (number, at) in zip(lengths, best_fit.placed_in_turn(lengths, 64), strict=True):
            of.setdefault(number, []).append((at, n))
        assert len(of) == _plain_best_fit(lengths, 64) and set(of) == set(range(len(of)))
        for places in of.values():
            assert [a for a, _ in sorted(places)] == list(np.cumsum([0, *(n for _, n in sorted(places))])[:-1]) and sum(n for _, n in places) <= 64


def test_gaps_of_later_ranges_take_what_earlier_ones_left():
    rng = random.Random(6)
    for _ in range(200):
        counts = [(q, rng.randint(0, 4), rng.randint(0, 4)) for q in range(6)]
        stack, plain = [], {}
        for q, wants, has in counts:
            for j in range(1, wants + 1):
                if stack:
                    plain[q, j] = stack.pop()
            stack += [(q, r) for r in range(1, has + 1)]
        mine = {(q, j): (of, top - (j - a)) for q, a, b, of, top in best_fit.matched_ranges(counts) for j in range(a, b + 1)}
        assert mine == plain


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = [None, "", "One tree, two trees.", "stone " * 700, "river tree " * 50, "a"]
    rows = best_fit.pack(_docs(spark, [(i if i else None, "s", t) for i, t in enumerate(texts)]), path, 64).collect()
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == (i or None)), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == [(k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert best_fit.pack(_docs(spark, [(1, "s", "x")]).limit(0), path).count() == 0
