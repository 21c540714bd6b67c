import numpy as np

from chronopanel.llm.fm_index import FMIndex, RangeLeast, common_prefixes, suffix_array
from chronopanel.llm.repeats import maximal_repeats


def _longest(texts, documents, i, at, before):
    """Length of the longest prefix of texts[i][at:] that stands in a text of an earlier document, or of any."""
    mine, best = texts[i][at:].tolist(), 0
    for j, t in enumerate(texts):
        if before is None or documents[j] < before:
            for q in range(len(t)):
                k = 0
                while k < min(len(mine), len(t) - q) and t[q + k] == mine[k]:
                    k += 1
                best = max(best, k)
    return best


def test_backward_search_gives_matching_statistics_with_earlier_documents():
    rng = np.random.default_rng(0)
    for _ in range(150):
        sizes, alphabet = rng.integers(1, 15, rng.integers(1, 8)), int(rng.integers(2, 6))
        documents = rng.integers(0, 5, len(sizes))
        texts = [rng.integers(1, alphabet, s) for s in sizes]
        flat = np.concatenate([np.append(t, 0) for t in texts])
        index = FMIndex(flat, np.repeat(documents, sizes + 1), int(sizes.max()) + 1)
        firsts = np.cumsum(sizes + 1) - sizes - 1
        for own in (documents, None):
            length = index.matching_statistics(flat, firsts, sizes, own).tolist()
            assert length == [_longest(texts, documents, i, at, None if own is None else own[i]) for i, t in enumerate(texts) for at in range(len(t))]


def test_statistics_of_texts_that_are_not_in_the_index():
    rng = np.random.default_rng(4)
    for _ in range(100):
        held, streamed = rng.integers(1, 4, rng.integers(1, 40)), [rng.integers(1, 9, rng.integers(1, 12)) for _ in range(4)]
        sizes = np.array([len(s) for s in streamed])
        length = FMIndex(held).matching_statistics(np.concatenate(streamed), np.cumsum(sizes) - sizes, sizes).tolist()
        assert length == [_longest([held, s], [0, 1], 1, at, 1) for s in streamed for at in range(len(s))]


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(100):
        tokens = rng.integers(0, 3, rng.integers(1, 50))
        order, levels = suffix_array(tokens)
        assert order.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:].tolist())
        said = [tokens[i:].tolist() for i in order]
        assert common_prefixes(order, levels).tolist() == [0, *(next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(said, said[1:], strict=False)), 0]


def test_range_least():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 100, 50)
    low = rng.integers(0, 49, 30)
    high = low + 1 + rng.integers(0, 50 - low)
    assert RangeLeast(values)(low, high).tolist() == [values[a:b].min() for a, b in zip(low, high, strict=True)]


def _all_maximal(strings, least):
    found = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                found.setdefault(s[a:b], []).append((i, a))
    out = []
    for u, at in found.items():
        left = {strings[i][a - 1] if a else ("start", i) for i, a in at}
        right = {strings[i][a + len(u)] if a + len(u) < len(strings[i]) else ("end", i) for i, a in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.append((len(u), sorted(at)))
    return sorted(out)


def test_maximal_repeats_with_all_occurrences():
    rng = np.random.default_rng(2)
    for _ in range(200):
        alphabet = [97, 98] if rng.random() < 0.3 else [0, 1, 255]
        strings = [bytes(rng.choice(alphabet, rng.integers(0, 25)).astype(np.uint8)) for _ in range(rng.integers(1, 5))]
        assert sorted((n, sorted(at)) for n, at in maximal_repeats(strings, 3)) == _all_maximal(strings, 3)
    assert maximal_repeats([], 3) == []
