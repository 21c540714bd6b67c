import random
import zlib

import numpy as np
import pytest
from tests.llm import brute

from chronopanel.llm import chat_format, decontaminate, html_extract, line_rules, lm_score, packing, quality_lines
from chronopanel.llm.lattice import Lattice, Vocabulary, read_vocabulary

ODD = ["", None, " \n\t ", "a", "A a A a", "Ünï ß İstanbul é x,y. don't 12 3.4", "w " * 5000, "\n".join(["same line here"] * 30), "tab\there\x0bthere\r\nend", "#*$%&|<> ## \\ [x] <b>"]


def _vocabulary(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(name)


# ---- packing


def test_words_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = _vocabulary("word_bpe_49k.json")
    rng = random.Random(1)
    alphabet = "abcABCéÉñßüΣσςЖ中İıﬁ0123.,;:!?'\"-_#$ \n\t…«»"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    whole, mine = Tokenizer.from_file(path), packing.WordCachedTokenizer(path)
    mine.MOST = 200  # forgets now and then
    for _ in range(2):
        for text, ids in zip(texts, mine.encode(texts), strict=True):
            assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_packing_loses_no_token_and_pads_little(spark):
    from tokenizers import Tokenizer

    path = _vocabulary("word_bpe_49k.json")
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["tree", "Stone,", "river", "x9"]) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    rows = packing.pack(docs, path, size=256, most_open=8).collect()
    whole = Tokenizer.from_file(path)
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for i, t in enumerate(texts):
        mine = sorted(pieces[i], key=lambda r: r.start)
        expected = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in mine for x in r.ids] == expected and {r.doc_tokens for r in mine} == {len(expected)}
        assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1])
    sizes = []
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == list(np.cumsum([0, *(r.length for r in w)])[:-1])
        sizes.append(sum(r.length for r in w))
    assert all(s == 256 or s & (s - 1) == 0 for s in sizes) and max(sizes) == 256
    assert packing.pack(docs.limit(0), path).count() == 0


def test_sum_of_squares_takes_the_level_that_is_best():
    packer = packing.SumOfSquaresPacker(10, 100)
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(1, 9)
        n = packer.levels.copy()

        def total(fill, n=n, length=length):
            after = n.copy()
            if fill:
                after[fill] -= 1
            after[fill + length] += 1
            return int((after[1:10] ** 2).sum())

        choices = [f for f in range(11 - length) if f == 0 or n[f]]
        assert total(packer._level(length)) == min(map(total, choices))
        list(packer.add(0, np.zeros(length, np.uint32)))


def test_as_many_windows_as_may_be_open_by_default():
    packer = packing.SumOfSquaresPacker(4096, 1024)
    rng = random.Random(13)
    sizes = [rng.randint(2100, 4000) for _ in range(3000)]
    out = [w for i, n in enumerate(sizes) for w in packer.add(i, np.full(n, i, np.uint32))]
    assert packer.n_open == 1024
    out += list(packer.finish())
    assert sum(len(p[2]) for w in out for p in w) == sum(sizes)
    assert all(sum(len(p[2]) for p in w) == 4096 for w in out[:-13])
    packer.levels[:], packer.n_open = 0, 1024
    packer.levels[3000] = 1024
    assert packer._level(1000) == 3000 and packer._level(1200) is None


# ---- chats


def test_chats_read_back_whatever_the_texts_hold(spark):
    rows = [(c, t, r, x, "x") for c, said in enumerate([["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>", "\\", "\\\\<[", "", None, "plain\n"], ["<", "|im_end|>"]]) for t, x in enumerate(said) for r in [["user", "assistant", "system", None][t % 4]]]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat_format.format_chats(messages.withColumn("parts", chat_format.text_parts(messages.text)))
    out = chats.withColumn("turns", chat_format.read_turns(chats.formatted)).withColumn("learned", chat_format.read_loss(chats.formatted, chats.loss_spans)).collect()
    odd = [(None, 0, "user", "a"), (None, 0, "user", "a"), (3, 5, "user", "b"), (3, 5, "assistant", "b"), (3, 5, "user", "b")]
    found = chat_format.format_chats(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_parts(chat_format.F.col("text"))))
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in found.select("conv_id", chat_format.read_turns(found.formatted).alias("turns")).collect()}
    assert found == {None: [("user", "a")] * 2, 3: [("assistant", "b"), ("user", "b"), ("user", "b")]}
    for r in out:
        mine = [(role or "", text or "") for c, _, role, text, _ in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert r.learned == "".join(t for role, t in mine if role == "assistant")


def test_parts_become_placeholders_with_attachments(spark):
    part = lambda **k: {c: k.get(c) for c in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [part(type="text", text="see "), part(type="image", ref="a.png", width=57, height=28), part(type="audio", ref="b.wav", seconds=1.5), part(type="document", ref="c.pdf", pages=2), part(type="video", ref="d")]
    messages = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")
    r = chat_format.format_chats(messages).first()
    assert "see <|image:1|><|audio:2|><|document:3|><|attachment:4|>" in r.formatted
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("video", "d", 0)]
    assert r.n_tokens_attached == 553
    assert chat_format.format_chats(messages.limit(0)).count() == 0


# ---- decontamination


def _contaminated(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta9", "été", "x"])
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([0, 3, 13, 30])))) for k in range(20)] + [(None, " ".join(["lone"] * 14)), ("i99", None)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 300))]
        if i % 2 and (said := rng.choice(items)[1]):
            w[5:5] = said.upper().split()
        rows.append((100 + i, rng.choice([" ", ", ", "\n"]).join(w)))
    rows.append((500, "lone " * 20))
    return rows, items


def test_contamination_matches_brute_force(spark, monkeypatch):
    rows, items = _contaminated()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, found int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    expected = brute.contamination(rows, items)
    for block in (1 << 20, 500):
        monkeypatch.setattr(decontaminate, "SET_BYTES", block)
        out = decontaminate.find_contamination(docs, bench, keep=["doc_id"]).collect()
        assert {r.doc_id: (r.found.n_words, r.found.n_hit, list(r.found.items), r.found.n_hit > 0 and 20 * r.found.n_hit >= r.found.n_words) for r in out} == expected
    size = sum(len((t or "").encode()) for _, t in items)
    monkeypatch.setattr(decontaminate, "SET_BYTES", -(-size // 8))
    eight = decontaminate.find_contamination(docs, bench)  # each block was a job of its own: the plan has the last step alone
    assert eight.columns == ["doc_id", "text", "found", "found_"] and eight._jdf.queryExecution().toString().count("MapInArrow") <= 4
    assert {r.doc_id: r.found_.n_hit for r in eight.collect()} == {d: x[1] for d, x in expected.items()}
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, x in expected.items() if not x[3]}
    spans = decontaminate.remove_spans(docs, bench)
    cleaned = [(r.doc_id, r.text) for r in spans.collect()]
    assert all(n == expected[d][0] - expected[d][1] for d, (n, *_) in brute.contamination(cleaned, []).items())
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0 and decontaminate.remove_documents(docs, bench.limit(0)).count() == len(rows)


# ---- pages


def test_main_text_of_a_page():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header><p>Site name, a long line of words that says nothing about it, at all.</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
    <div class="ad-box">Buy this, now, and that, and everything else that we have for sale today.</div>
    <article><h1>Head &amp; tail</h1><p>First paragraph, with commas, and   enough words to be one &lt;b&gt;, surely.<p>Second <b>bold</b> one<br>goes on, with &eacute;clairs, and more and more words.</p>
    <ul><li>item one</ul><div class=related><a href=1>More</a> <a href=2>Other</a></div></article>
    <section id="comments"><p>I think, as a reader, that this is wrong, and I say so at some length here.</p></section><footer>Copyright, all rights, reserved, by us, for a long time.</footer></body></html>"""
    assert html_extract.main_text(page).split("\n") == ["Head & tail", "First paragraph, with commas, and enough words to be one <b>, surely.", "Second bold one goes on, with éclairs, and more and more words.", "item one"]


def test_odd_pages(spark):
    odd = [None, "", "<p>", "plain words & more", "<div><div>" * 3000 + "deep text in here, with words", "<!-- open", "<p>a<p>b</i></div>c", "<script>x", "\x00<p>é</p>"]
    pages = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(odd)], "page_id long, url string, html string, kind string")
    out = {r.page_id: r.text for r in html_extract.extract(pages, keep=["page_id", "url"]).collect()}
    assert out[0] == out[1] == out[2] == out[5] == out[7] == "" and out[3] == "plain words & more" and out[4] == "deep text in here, with words"
    assert html_extract.extract(pages.limit(0)).count() == 0


def _page(rng):
    """A page and the blocks of its article."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", ", " + word() + "."])
    blocks, body = [], []
    for _ in range(rng.randint(3, 12)):
        kind, text = rng.choice(["p", "p", "p", "h2", "li", "link", "section", "legal", "pre"]), said(rng.randint(4, 50))
        blocks.append(text)
        body.append({"li": f"<ul><li>{text}</li></ul>", "link": f'<p><a href="x">{text}</a></p>', "section": f'<section class="discussion"><p>{text}</p></section>', "legal": f'<p class="legal">{text}</p>'}.get(kind, f"<{kind}>{text}</{kind}>"))
        if rng.random() < 0.2:
            body.append(rng.choice([f'<div class="related"><a href="y">{said(3)}</a></div>', f"<aside>{said(9)}</aside>", f'<div class="share">{said(2)}</div>']))
    menu = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(6))
    rest = [f"<footer><p>{said(12)}</p></footer>", f'<div id="comments"><p>{said(30)}</p></div>', f'<div class="ad">{said(15)}</div>', f"<form>{said(4)}<input></form>"]
    rng.shuffle(rest)
    return f"<html><head><title>{word()}</title><style>p{{}}</style></head><body><header><p>{said(8)}</p></header><nav><ul>{menu}</ul></nav><article>{''.join(body)}</article>{''.join(rest)}</body></html>", blocks


def test_generated_pages_against_their_text_and_a_plain_reader():
    rng = random.Random(12)
    found = kept = known = 0
    for _ in range(200):
        page, blocks = _page(rng)
        text = html_extract.main_text(page)
        assert text == brute.main_text(page)
        mine = text.split("\n")
        found, kept, known = found + len(set(mine) & set(blocks)), kept + len(mine), known + len(blocks)
    assert found == kept == known


@pytest.mark.parametrize("n", [99_000, 100_100])
def test_an_advert_is_cut_however_long_the_page(n):
    text = html_extract.main_text("<article>" + "<p>para, one</p>" * n + '<div class="ad">ADVERT</div></article>')
    assert text == "\n".join(["para, one"] * n)


def test_what_an_article_keeps_and_loses():
    lead = "Some long enough text, with commas, and more words to be read here."
    keeps = ["<p><a href=x>See the full report</a></p>", "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul>", '<section class="discussion"><h2>Discussion</h2></section>', '<p class="legal">Law</p>', '<div class="search-results">Results</div>', "<p>f <math><mi>x</mi></math></p>"]
    loses = ['<div class="related-content">no</div>', '<div class="main-nav">no</div>', "<aside>no</aside>", '<div class="comments">no</div>', "<form>no</form>", '<div role="navigation">no</div>']
    page = f"<body><article><p>{lead}</p>{''.join(keeps)}{''.join(loses)}</article></body>"
    assert html_extract.main_text(page).split("\n") == [lead, "See the full report", "One", "Two", "Discussion", "Law", "Results", "f x"]


def test_names_of_which_one_word_would_cut():
    lead = "".join(f"<p>Paragraph {i} of an article, with commas, and with words enough to be read as running text.</p>" for i in range(4))
    prose = "<p>What this part has to say, at length, in running text that belongs to the article as much as any other.</p>"
    said = "What this part has to say, at length, in running text that belongs to the article as much as any other."
    whole = [f"Paragraph {i} of an article, with commas, and with words enough to be read as running text." for i in range(4)]
    for kept in (f'<p class="related">{said}</p>', f'<div class="social-science">{prose}</div>', f'<section id="navigation-at-sea">{prose}</section>', f'<section class="widget-theory">{prose}</section>', f'<section class="related">{prose}</section>', f'<h2 class="share">{said}</h2>', f'<section class="reactions">{prose}</section><p>After it.</p>'):
        found = html_extract.main_text(f"<body><article>{lead}{kept}</article></body>").split("\n")
        assert found[:4] == whole and found[4] == said, kept
    for gone in ('<div class="responses">Great post, thanks!</div>', f'<div class="reader-reactions">{prose}</div>', f'<section class="comments">{prose}</section>', f'<section class="replies">{prose}</section>', '<div class="related-links"><a href=x>Another one</a></div>', '<div class="newsletter-hero">Sign up</div>', f'<div class="cookie-notice">{prose}</div>'):
        assert html_extract.main_text(f"<body><article>{lead}{gone}</article></body>").split("\n") == whole, gone
    plain = html_extract.main_text(f'<body><div id="page">{lead}<section class="legal">{prose}</section><h2>References</h2><ul><li><a href=x>Smith 2001</a></li><li><a href=y>Jones 2002</a></li></ul><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></div></body>')
    assert plain.split("\n") == [*whole, said, "References", "Smith 2001", "Jones 2002"]
    titled = html_extract.main_text(f"<body><main><h1>The title</h1><article>{lead}</article><p>Elsewhere</p></main></body>")
    assert titled.split("\n") == ["The title", *whole]


def test_unclosed_quotes_take_linear_time():
    import time

    took = []
    for n in (4_000, 32_000):
        began = time.time()
        for page in ('<a "' * n, "<a '\"" * n, '<a b="' * n + ">", "<p " * n + '"'):
            html_extract.main_text(page)
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 1
    assert html_extract.main_text("<p title=\"a > b\" x='>'>said</p>") == "said"
    assert html_extract.main_text('<p title="never closed>said</p>') == "said"


def test_extraction_takes_linear_time_and_keeps_columns(spark):
    import time

    took = []
    for n in (4_000, 32_000):
        began = time.time()
        html_extract.main_text("<div>" * n + "<p>hello</i></b></p>" * n)
        html_extract.main_text("<b>" * n + "<div></div>" * n)
        html_extract.main_text("<ul><li><ul>" + "<div>" * n + "<li></li>" * n)
        took.append(time.time() - began)
    assert took[1] < 40 * took[0]
    pages = spark.createDataFrame([(1, "<p>a</p>", "x")] * 2, "page_id long, html string, text string")
    assert [(r.text, r.text_) for r in html_extract.extract(pages).collect()] == [("x", "a")] * 2


def test_elements_late_in_a_very_long_page():
    lines = [f"Paragraph {i}, with commas, and enough words to be kept." for i in range(60_000)]
    body = "".join(f"<p><b>{x}</b></p>" for x in lines)
    page = f"<html><body><article>{body}<div><p>A last one, nested, with words enough to be kept.</p></div><p>And after it, one more, of the same article.</p></article><footer><p>Copyright, all rights, reserved.</p></footer></body></html>"
    assert html_extract.main_text(page).split("\n") == [*lines, "A last one, nested, with words enough to be kept.", "And after it, one more, of the same article."]
    assert html_extract.main_text("<div>" * 150_000 + "deep text in here, with words<footer>no</footer>") == "deep text in here, with words"


def test_benchmark_blocks_are_bounded_whatever_the_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 300)
    rng = random.Random(9)
    said = " ".join(rng.choice(["one", "Two", "été", "four4"]) for _ in range(40))
    long = [str(i) for i in range(3000)]
    items = [(f"same{k}", said) for k in range(50)] * 2 + [("long", " ".join(long)), (None, said), ("none", None), ("short", "a b c")]
    total = 51 * len(said.encode()) + 51 * 6 + len(" ".join(long))
    monkeypatch.setattr(decontaminate, "SET_BYTES", total // 20)
    bench = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    blocks, n = decontaminate.benchmark_blocks(bench, 13)
    sizes = {}
    for r in blocks.collect():
        sizes.setdefault(r.block, []).append(len(r.said.encode()) + len(r.item or ""))
    assert n >= 20 and set(sizes) == set(range(n)) and max(map(sum, sizes.values())) <= total // 20 + 400
    windows = [" ".join(p.split()[i : i + 13]) for p in decontaminate.pieces_of(" ".join(long), 13, 300) for i in range(len(p.split()) - 12)]
    assert windows == [" ".join(long[i : i + 13]) for i in range(len(long) - 12)]
    docs = [(1, said), (2, " ".join(long[1490:1520])), (3, "x a b c"), (4, None)]
    out = {r.doc_id: (r.found.n_hit, list(r.found["items"])) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert out == {1: (40, sorted(f"same{k}" for k in range(50))), 2: (30, ["long"]), 3: (3, ["short"]), 4: (0, [])}


def test_words_of_many_blocks_meet_their_blocks_as_others_do(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(b, i, w) for b in range(30) for i, w in enumerate(sorted({rng.choice("abcdefgh") for _ in range(4)} | {"all"}))]
    lists = spark.createDataFrame(rows, "block long, code int, word string").repartition(4)
    times = {w: sum(r[2] == w for r in rows) for _, _, w in rows}
    weighed = spark.createDataFrame([(w, n * 10, n, -float(n)) for w, n in times.items()], "word string, c long, blocks long, log_p double")
    for often, most in ((1000, 100), (1, 100), (12, 100), (1, 3)):
        monkeypatch.setattr(lm_score, "OFTEN", often)
        monkeypatch.setattr(lm_score, "MOST_SENT", most)
        out = lm_score._in_blocks(lists, weighed)
        assert sorted((r.block, r.code, r.word, r.c, r.log_p) for r in out.collect()) == sorted((b, i, w, times[w] * 10, -float(times[w])) for b, i, w in rows)


# ---- quality of lines


def _graded(n, seed):
    rng = random.Random(seed)
    plain = lambda: " ".join(rng.choice(["the", "river", "stone", "of", "walked", "slowly", "and", "house"]) for _ in range(rng.randint(5, 20))).capitalize() + "."
    junk = [lambda: " | ".join(plain() for _ in range(3)), lambda: plain().upper().replace(" ", "!! "), lambda: plain().replace(" ", "### ")]
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        bad = rng.choice(junk)
        lines = [plain() if good or rng.random() < 0.2 else bad() for _ in range(rng.randint(2, 12))]
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def test_field_tells_good_from_bad(spark):
    rows = _graded(400, 5)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(1000 + k, t, "s") for k, t in enumerate(ODD)] + [(None, "x", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 250] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    model = quality_lines.train(docs, labels, most=150)
    out = {r.doc_id: r.q for r in quality_lines.score(docs, model, keep=["doc_id"], name="q").collect()}
    assert all(0 <= s <= 1 for s in out.values())
    held = [(out[i], y) for i, _, y in rows if i >= 250]
    assert sum((s >= 0.3) == bool(y) for s, y in held) >= 0.95 * len(held)
    assert out[1000] == out[1001] == out[1002] == model.mean
    assert quality_lines.train(docs, labels, most=150, most_lines=0).field is None
    assert quality_lines.score(docs, model).columns == ["doc_id", "text", "score", "score_"]
    kept = quality_lines.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.3 for s in out.values())
    for none in (labels.limit(0), labels.where("quality = 1")):
        flat = quality_lines.train(docs, none)
        assert flat.field is None and {round(r.q, 6) for r in quality_lines.score(docs, flat, keep=[], name="q").collect()} == {flat.mean}
    assert quality_lines.score(docs.limit(0), model, name="q").count() == 0


def test_marginals_match_all_paths():
    from itertools import product

    from chronopanel.llm import chain_field

    rng = np.random.default_rng(6)
    field = chain_field.ChainField(rng.normal(size=7), rng.normal(size=(2, 2)))
    lines, firsts = rng.normal(size=(9, 2)), np.array([0, 4, 4, 9])
    good = chain_field.emissions(field, lines, firsts)
    found = chain_field.good_marginals(field, lines, firsts)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        weights, marks = [], []
        for path in product((0, 1), repeat=b - a) if b > a else []:
            score = sum(good[a + t] * s for t, s in enumerate(path)) + sum(field.moves[p, q] for p, q in zip(path, path[1:], strict=False))
            weights.append(np.exp(score))
            marks.append(path)
        if marks:
            assert np.allclose(found[a:b], np.array(weights) @ np.array(marks) / sum(weights))


# ---- line rules


@pytest.mark.parametrize("sent", [line_rules.MOST_SENT, 0])
def test_line_rules_match_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(line_rules, "MOST_SENT", sent)
    rng = random.Random(7)
    common = ["Share this page 12", "share  THIS page 99", "all rights reserved", "x"]
    rows = [(i, rng.choice(["a", "b", None, ""]), t) for i, t in enumerate(ODD)]
    for i in range(120):
        lines = [rng.choice(common) if rng.random() < 0.4 else " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        rows.append((100 + i, rng.choice(["a", "b", None]), rng.choice(["\n", "\r\n", "\n\n"]).join(lines)))
    rows += [(900 + k, "a", "only copies of this line") for k in range(30)]
    docs = spark.createDataFrame([(d, h, t, 0) for d, h, t in rows], "doc_id long, source string, text string, row int").repartition(3)
    out = line_rules.with_line_counts(docs, keep=["doc_id"], most=8).collect()
    assert {r.doc_id: tuple(r.rules[c] for c in (*line_rules.COUNTS, "n_frequent_words")) for r in out} == brute.line_rules(rows, 8)
    kept = line_rules.remove_frequent_lines(docs, most=8)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert not any(w in r.text.lower() for w in ("share", "reserved"))
    assert line_rules.with_line_counts(docs.limit(0)).count() == 0


def test_each_copy_of_a_text_is_a_document_by_its_id(spark):
    text = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz")
    rows = [(k, "a", text) for k in range(9)] + [(100 + k, "b", text) for k in range(8)] + [(None, "c", text)] * 9 + [(200, "d", text)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    out = line_rules.with_line_counts(docs, keep=["source"], most=8).collect()
    assert {(r.source, r.rules["n_frequent_words"]) for r in out} == {("a", 64), ("b", 0), ("c", 64), ("d", 0)} and len(out) == len(rows)
    assert {r.source for r in line_rules.remove_frequent_lines(docs, most=8).collect()} == {"b", "d"}


# ---- lattice


def test_lattice_sums_over_all_segmentations():
    rng = np.random.default_rng(8)
    pieces = ("▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", *(f"\0{i}" for i in range(256)))
    weights = rng.random(len(pieces)) + 0.1
    weights /= weights.sum()
    lattice = Lattice(Vocabulary(pieces, weights, np.arange(8, 264)), np.log(weights))

    def total(word):
        word, sums = "▁" + word, [1.0]
        for j in range(1, len(word) + 1):
            s = sum(sums[j - len(p)] * w for p, w in zip(pieces[:8], weights, strict=False) if word[:j].endswith(p))
            if word[j - 1] not in "▁ab":
                s += sums[j - 1] * np.prod([weights[8 + x] for x in word[j - 1].encode()])
            sums.append(s)
        return np.log(sums[-1])

    words = ["a", "abab", "baab", "é", "abéa", "b" * 12]
    assert np.allclose(lattice.log_marginals(words), [total(w) for w in words])


def _weights(vocabulary, pieces):
    """Of pieces by name, and of bytes."""
    return dict(zip(vocabulary.pieces, pieces.tolist(), strict=True)), {b: pieces[i] for b, i in enumerate(vocabulary.spelled)}


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_scores_are_sums_over_all_segmentations(spark, rounds):
    texts = ["tree stones", "tree tree río", None, "Tre estone", "žx", "tree stones", "never seen"]
    docs = spark.createDataFrame([(i if i < 6 else None, t) for i, t in enumerate(texts)] + [(9, "held out trees")] * 2, "doc_id long, text string")
    path, held = _vocabulary("piece_bpe_32k.model"), docs.doc_id == 9
    vocabulary = read_vocabulary(path)
    train = [w for t in texts for w in brute.words(brute.lower(t))]
    prior = lm_score.STRENGTH * vocabulary.weights
    pieces, end = prior / (lm_score.STRENGTH + 1), 1 / (lm_score.STRENGTH + 1)
    for _ in range(rounds):
        weights, of_byte = _weights(vocabulary, pieces)
        counts, index = prior.copy(), {p: i for i, p in enumerate(vocabulary.pieces)}
        for word in train:
            ways = brute.segmentations("▁" + word, weights, of_byte)
            whole = sum(w for _, w in ways)
            for way, w in ways:
                for piece in way:
                    for i in [index[piece]] if piece in index else [vocabulary.spelled[b] for b in piece.encode()]:
                        counts[i] += w / whole
        total = counts.sum() + len(texts) + 1
        pieces, end = counts / total, (len(texts) + 1) / total
    weights, of_byte = _weights(vocabulary, pieces)
    assert abs(pieces.sum() + end - 1) < 1e-9
    out = lm_score.score_documents(docs, path, held, rounds=rounds).collect()
    assert len(out) == len(texts) + 2
    score = lambda t: np.log10(end) + sum(np.log10(sum(w for _, w in brute.segmentations("▁" + x, weights, of_byte))) for x in brute.words(brute.lower(t)))
    of = {**dict(enumerate(texts)), None: texts[6], 9: "held out trees"}
    for r in out:
        assert abs(r.score - score(of[r.doc_id])) < 1e-6, r


def test_scores_of_documents(spark):
    rng = random.Random(9)
    texts = ODD + [" ".join(rng.choice(["tree", "stone", "River", "été"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["zzqx unseen wordless"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    held = docs.doc_id % 4 == 1
    out = {r.doc_id: r for r in lm_score.score_documents(docs, _vocabulary("piece_bpe_32k.model"), held, rounds=1).collect()}
    split = {i: [*brute.words(brute.lower(t)), None] for i, t in enumerate(texts)}
    train = [w for i, ws in split.items() if i % 4 != 1 for w in ws]
    count = {w: train.count(w) for w in set(train)}
    for i, ws in split.items():
        r = out[i]
        base = sum(np.log10((count.get(w, 0) + 0.5) / (len(train) + 0.5 * (len(count) + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 == 1, len(ws), sum(w in count for w in ws), len(train))
        assert abs(r.base_score - base) < 1e-6 and np.isfinite(r.score) and r.score < 0
    assert lm_score.score_documents(docs.limit(0), _vocabulary("piece_bpe_32k.model"), held).count() == 0
    assert len(read_vocabulary(_vocabulary("piece_bpe_32k.model")).pieces) > 20_000
