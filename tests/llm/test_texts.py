"""Media, pages, chats, quality, packing, mixing and language-model scores."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.llm import attention, chat, media, mixing, packing, quality, scoring, wrappers

TEXTS = ["Plain words, some more.", "", None, " ", "ÄÖ ß é퟿\U0001f600", "x" * 70_000, "<s>[INST] \\ </s>", "Plain words, some more.", "a\tb\nc\x0bd\x0ce\rf", "<|endoftext|> don't 12,5 İstanbul"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, media string")


# Media


def slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum():
    for n in (0, 1, 7, 300):
        data = random.Random(n).randbytes(n)
        assert media.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 192, 7680, 7681, 65_024, 65_025, 65_280, 300_000])
def test_media_round_trip(n):
    rng = random.Random(n)
    payload = media.padded(rng.randbytes(n))
    stored = media.write_media(payload)
    back, props = media.read_media(stored)
    assert back == payload and len(payload) % 192 == 0 and props["streams"] == 2
    assert props["seconds"] == pytest.approx(len(payload) / media.RATE)
    for _ in range(5):
        i = rng.randrange(len(stored))
        with pytest.raises(media.MediaError):
            media.read_media(stored[:i] + bytes([stored[i] ^ 4]) + stored[i + 1 :])
    with pytest.raises(media.MediaError):
        media.read_media(stored[:-1])


def test_granules_give_times():
    streams = media.demultiplex(media.write_media(bytes(media.PACKET * 5)))
    times = [s.times() for s in streams.values()]
    step = media.PACKET / media.RATE
    assert [t[-1][1] for t in times] == pytest.approx([3 * step, 2 * step]) and times[0][1] == pytest.approx((step, 2 * step))


def test_media_digests(spark):
    rows = {r.doc_id: r for r in media.media_digests(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode("utf-8", "surrogatepass")
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[0][1:] == rows[7][1:] and rows[1][1:] == rows[2][1:]
    stored = media.encode_documents(docs(spark)).where("doc_id = 0").first()
    assert hashlib.sha256(stored.media).hexdigest() == rows[0].media_sha256 and len(stored.media) == rows[0].media_bytes
    assert media.media_digests(docs(spark).limit(0)).count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) document.write("</p>")</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
<div id="cookie-notice"><p>We use cookies</p></div>{open}<h1>Title {n}</h1><p>First &amp; <b>bold</b>&nbsp;text {n}<br>line<p>Second &lt;p&gt; {n}
<div class="advert">Buy {n}</div><ul><li>one {n}<li>two</ul><form><p>Mail</p><input></form><aside>See {n}</aside>{close}
<section class="comments"><p>Nice {n}</p></section><div class="sidebar"><p>Side {n}</p></div><footer><p>&copy; me</p></footer></body></html>"""
WANT = "Title {n}\n\nFirst & bold text {n} line\n\nSecond <p> {n}\n\none {n}\n\ntwo"


@pytest.mark.parametrize(("opened", "closed"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="story body">', "</div>")])
def test_pages(spark, opened, closed):
    rows = [(n, f"https://h.example/{n}", PAGE.format(n=n, open=opened, close=closed)) for n in range(6)]
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(6):
        assert got[n].text == WANT.format(n=n) and got[n].n_chars == len(got[n].text)


@pytest.mark.parametrize("url", ["http://a_b.example/{}", "https://münchen.example/{}", "http://H.example/a b|{{{}}}", "http://u@h.example:80/50%{}"])
def test_odd_hosts(spark, url):
    """Pages meet their host's wrapper whatever else is odd in the URL; pages without a host don't give theirs away."""
    made = mixed_pages(12, 5, random.Random(9))
    rows = [(i, url.format(i), source) for i, (_, source) in enumerate(made)] + [(100 + i, None, source.replace("story", "tale")) for i, (_, source) in enumerate(made)]
    got = {r.page_id: r.text.split("\n\n") for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (story, _) in enumerate(made):
        assert got[i] == got[100 + i] == [wrappers.re.sub("<[^>]*>", "", x) for x in story]


def test_odd_pages(spark):
    rows = [(0, None, None), (1, "::", ""), (2, "http://a/", "no markup, 1 < 2 &am"), (3, "http://a/", "<article><p>cut <b>off"), (4, "http://a/", "<article><p>x</p><!-- open"), (5, "http://[", "<p>" * 300 + "deep"), (5, "http://[", "<p>" * 300 + "deep")]
    got = sorted((r.page_id, r.text) for r in wrappers.main_text(spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("rule", F.lit(1))).collect())
    assert got == [(0, ""), (1, ""), (2, "no markup, 1 < 2 &am"), (3, "cut off"), (4, "x"), (5, "deep"), (5, "deep")]
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_inference():
    """Mismatches become optional, neighbours repeated, texts slots that change or stay."""
    pages = ["<div><h2>A</h2><p>1</p><p>2</p><span>s</span></div>", "<div><h2>A</h2><p>3</p><table><tr><td>x</td></tr></table></div>", "<div><h2>A</h2></div>"]
    w = []
    for n, p in enumerate(pages):
        own = wrappers.fold([wrappers.item(c, n) for c in wrappers.parse(p).children])
        w = wrappers.align(w, own) if w else own
    items = {x["k"]: x for x in w[0]["c"]}
    assert items["h2"]["q"] == "1" and len(items["h2"]["c"][0]["T"]) == 1 and len(items["h2"]["c"][0]["P"]) == 3
    assert items["p"]["q"] == "*" and len(items["p"]["c"][0]["T"]) == 3 and items["table"]["q"] == "?"
    group = wrappers.fold([wrappers.item(c) for c in wrappers.parse("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>").children])
    assert group[0]["c"][0]["k"] == "(dt dd)" and group[0]["c"][0]["q"] == "+"


def mixed_pages(n, blocks, rng):
    """Pages with an article of mixed blocks in an unmarked block beside a menu that stays and teasers that change."""
    out = []
    for i in range(n):
        story = [rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<pre>{}</pre>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(f"text {i} {k}") for k in range(blocks)]
        out.append((story, f'<body><div class="top"><p>Menu</p>Site name</div><div class="story">{"".join(story)}</div><div class="teasers"><p>Teaser {i}</p></div></body>'))
    return out


@pytest.mark.parametrize(("pages", "blocks", "ordered"), [(12, 250, None), (300, 30, None), (12, 250, 100)])
def test_long_mixed_lists(monkeypatch, pages, blocks, ordered):
    """A long child list keeps its text statistics, whether its order is kept or not."""
    if ordered:
        monkeypatch.setattr(wrappers, "MOST_ORDERED", ordered)
    made = mixed_pages(pages, blocks, random.Random(8))
    w = None
    for n, (_, source) in enumerate(made):
        own = wrappers.fold([wrappers.item(c, n) for c in wrappers.parse(source).children])
        w = wrappers.align(w, own) if w else own
    rule = wrappers.rules(w)
    assert rule["root"] == "/body/div.story"
    assert rule["drop"] == ["/body/div.top/#", "/body/div.top/p/#"]
    for story, source in made:
        assert wrappers.extract(wrappers.parse(source), rule).split("\n\n") == [wrappers.re.sub("<[^>]*>", "", x) for x in story]


def plain_pages(n, rng, host):
    """Pages of a host whose markup tells nothing: (page_id, url, html), and the main text of each by its making."""
    word = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    menu = "".join(f"<li>{word(2)}</li>" for _ in range(6))
    notice, foot = word(12), word(9)
    pages, want = [], []
    for i in range(n):
        title, paragraphs = word(5), [word(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 7))]
        body = [f"<h2>{title}</h2>"]
        for k, x in enumerate(paragraphs):
            body.append(f"<p>{x}</p>")
            if k == 1 and rng.random() < 0.5:
                body.append(f'<div class="k7"><a href="/x">{word(6)}</a> now</div>')
        remarks = "".join(f'<div class="v2"><span>{word(1)}</span><p>{word(rng.randrange(5, 30))}</p></div>' for _ in range(rng.randrange(0, 5)))
        teasers = "".join(f'<p><a href="/{k}">{word(7)}</a></p>' for k in range(5))
        advert = f'<div class="b{i}"><p>{word(8)}</p></div>' if rng.random() < 0.6 else ""
        page = f'<html><body><div class="q1"><ul>{menu}</ul><p>{notice}</p></div>{advert}<div class="z"><div class="t">{"".join(body)}</div>{f"<div class={chr(34)}u{chr(34)}>{remarks}</div>" if remarks else ""}<div class="w">{teasers}</div></div><div class="y"><p>{foot}</p></div></body></html>'
        pages.append((len(host) * 1000 + i, f"http://{host}/{i}", page))
        want.append("\n\n".join([title, *paragraphs]))
    return pages, want


@pytest.mark.parametrize("n", [40, 12])
def test_hosts_without_names(spark, n):
    """Articles of hosts without telling tags, classes, roles: menus, notices, adverts, teasers, comments go, by the wrapper
    alone, whatever the order of pages and their parts; and pages that occur many times change nothing."""
    rng = random.Random(n)
    made = [plain_pages(n, rng, f"host{k * 'x'}") for k in range(4)]
    rows = [p for pages, _ in made for p in pages]
    want = {p[0]: t for pages, texts in made for p, t in zip(pages, texts)}
    kind = "page_id long, url string, html string"
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, kind)).collect()}
    assert got == want
    assert all(wrappers.extract(wrappers.parse(html), None) != want[i] for i, _, html in rows)
    shuffled = [*rows, *rows[:3] * 30]
    rng.shuffle(shuffled)
    again = wrappers.main_text(spark.createDataFrame(shuffled, kind).repartition(7)).collect()
    assert {r.page_id: r.text for r in again} == want and len(again) == len(shuffled)
    one, two = (sorted((r.host, r.wrapper) for r in wrappers.infer_wrappers(spark.createDataFrame(x, kind).repartition(k)).collect()) for x, k in ((rows, 3), (rows[::-1], 5)))
    assert one == two


def test_same_article_everywhere(spark):
    """A host all of whose pages hold one article keeps it."""
    rows = [(i, f"http://same/{i}", f"<body><p>menu {i}</p><article><p>one text for all</p></article></body>") for i in range(30)]
    assert {r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"one text for all"}


def test_alignments_agree(monkeypatch):
    """Rows of numbers give the alignment that the plain recurrence gives."""
    rng = random.Random(5)
    for n in (1, 7, 40):
        ka, kb = (rng.choices("abcd", k=rng.randrange(1, n + 1)) for _ in range(2))
        monkeypatch.setattr(wrappers, "FEW_ITEMS", 1000)
        plain = wrappers.preferred(ka, kb)
        monkeypatch.setattr(wrappers, "FEW_ITEMS", 0)
        assert wrappers.preferred(ka, kb).tolist() == plain


# Chats


def turns():
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(1, i, "assistant" if i % 2 else "user", f"turn {i} \\l [INST " * (i % 9)) for i in range(60)]
    rows += [(2, 0, "system", "be brief"), *((2, i, "assistant" if i % 2 == 0 else "user", "word " * 90 + str(i)) for i in range(1, 40))]
    rows += [(3, 0, "assistant", "long " * 5000), (4, 0, None, None), (4, 1, "to\nol", "<\\s>"), (5, 0, "user", ""), (6, 1, "assistant", "b"), (6, 1, "assistant", "a"), (6, None, "user", "first"), (None, 0, "user", "x")]
    return rows


def test_chats(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").repartition(4).withColumn("mask", F.lit(1))
    by: dict = {}
    for r in sorted(turns(), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    for k, own in by.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[k]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    w = chat.format_chats(df).where("conv_id = 2").orderBy("window").collect()
    assert len(w) > 3
    for r in w[1:]:
        parts = chat.read_window(r.formatted)
        assert parts[0] == (False, "system", "be brief") and [p[0] for p in parts] == sorted(p[0] for p in parts)
        assert len(r.mask) == 2 * sum(p[0] and p[1] == "assistant" for p in parts)
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_chat_budget(spark):
    """Windows hold no more tokens than the budget, marks and roles counted, unless one new turn alone is larger."""
    rows = [(1, i, "user", "") for i in range(5000)] + turns()[2:62] + [(9, i, None, f"[INST] {i} <s> \\") for i in range(900)]
    df = spark.createDataFrame([(c if c is None or c == 9 else 1 + (t or 0) % 1 + c, t, r, x) for c, t, r, x in rows], "conv_id long, turn long, role string, text string")
    tok = packing.word_ids(packing.default_tokenizer()).tok
    got = chat.format_chats(df).collect()
    sizes = [len(tok.encode(r.formatted, add_special_tokens=False).ids) for r in got]
    assert all(n <= chat.BUDGET or r.n_new == 1 for n, r in zip(sizes, got))
    assert sum(r.n_new for r in got) == len(rows) and len(got) > 5000 * 4 // chat.BUDGET


def test_escapes():
    for t in ("", "\\", "<s", "<s>", "<</s>>", "[[INST]]", "\\<s>\\l", "[/INST]x</s>"):
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in (chat.BEGIN, chat.END, chat.NEW, chat.OLD))


# Quality


def test_quality(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["river", "stone", "light", "walks", "under", "green"]) for _ in range(60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY", "NOW!!!", "$$$", "CLICK", "WIN###"]) for _ in range(60)) for _ in range(120)]
    texts = [*good, *bad, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score_", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out and i < 240} == set(held)
    assert sum(got[i].predicted == (i < 120) for i in held) >= 0.95 * len(held)
    assert got[240].score == got[241].score and all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in quality.keep_good(df, labels).collect()} == {i for i, r in got.items() if r.predicted}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.classify(df, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), labels).count() == 0


# Packing


def test_packing(spark):
    rng = random.Random(1)
    texts = [*TEXTS, *(" ".join(rng.choice(["alpha", "Beta,", "gamma!", "délta"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)), "long words " * 9000]
    df = docs(spark, texts).withColumn("rank", F.lit(1))
    tok = packing.word_ids(packing.default_tokenizer()).tok
    want = {}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = packing.pack(df).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seqs) == -(-sum(n for _, n, _ in want.values()) // 4096)
    assert packing.pack(df.limit(0)).count() == 0


def test_bin_completion():
    assert packing.plan_packing({60: 2, 50: 2, 40: 2, 30: 1, 20: 1, 10: 2}, 100).sequences == 4
    assert packing.plan_packing({}, 100).sequences == 0
    rng = random.Random(2)
    counts = Counter(rng.randrange(150, 700) for _ in range(400))
    plan = packing.plan_packing(counts, 1000)
    used: Counter = Counter()
    for fill, m in plan.fills:
        assert sum(s * k for s, k in fill) <= 1000
        for s, k in fill:
            used[s] += k * m
    assert used == counts and plan.sequences <= -(-sum(s * c for s, c in counts.items()) // 1000) + 4


# Mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {**capped, **{s: rest * weight[s] / w for s in free}}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "b", "b", "c", None, "é", "z"]), 1) for i in range(500)]
    rows += [(900, None, "a", 1), (901, "", "empty", 1), (1, rows[1][1], rows[1][2], 1), (1, rows[1][1], rows[1][2], 1), (None, "x y", "a", 1), (902, "one two", "tiny", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mix_sources(df).collect()
    sizes: Counter = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken: Counter = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 80 for s in want) and sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix_sources(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(df.limit(0)).count() == 0


# Language model


LOWER = {c: c + 32 for c in range(65, 91)}


def test_subwords_are_the_tokenizers():
    """Words encoded many at a time have the subwords that they have alone, white space of other kinds or not."""
    words = ["don't", "12,5", "é", "\u00a0", "a\u00a0b", "\u3000x\u2003", "<|endoftext|>", "...", "\U0001f600", "İ", "x" * 300, "'s"] * 3
    path = scoring.default_tokenizer()
    ids, counts = scoring.encode_words(path, words)
    each = [scoring.encoding(path)[0].encode_ordinary(" " + w) for w in words]
    assert ids.tolist() == sum(each, []) and counts.tolist() == list(map(len, each))
    plain = [w for w in words if not scoring.OTHER_SPACE.search(w)]
    ids, counts = scoring.encode_words(path, plain)
    assert ids.tolist() == sum((scoring.encoding(path)[0].encode_ordinary(" " + w) for w in plain), [])
    flat, lens = scoring.split_words(scoring.pa.array([" A b\tÉ\x0b", None, "", "\u00a0x\x1cy  z"]), lower=True)
    assert flat.to_pylist() == ["a", "b", "É", "\u00a0x\x1cy", "z"] and lens.tolist() == [3, 0, 0, 2]


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in attention.initial(30).items()}
    for k in ("wo", "w2", "bias"):
        p[k] = rng.standard_normal(p[k].shape) * 0.2
    w = attention.windows(rng.integers(0, 29, 70), np.array([50, 20]), 29)
    y = (np.arange(30) % attention.CLASSES)[w.targets]

    def run():
        return attention.gradients(p, p["emb"][w.inputs], y, w.scored)

    _, g = run()
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], w.inputs.ravel(), g["rows"])
    for k in attention.NAMES:
        at = tuple(rng.integers(0, s) for s in p[k].shape) if k != "emb" else (int(w.inputs[0, 1]), 0)
        old, h = p[k][at], 1e-4
        p[k][at] = old + h
        up = run()[0]
        p[k][at] = old - h
        down = run()[0]
        p[k][at] = old
        assert (up - down) / (2 * h) == pytest.approx(g[k][at], abs=2e-5)


@pytest.mark.parametrize("lengths", [[1], [32, 33, 1], [24, 25, 56, 57, 200], [0, 5, 0]])
def test_windows_score_each_token_once(lengths):
    ids = np.arange(sum(lengths))
    w = attention.windows(ids, np.array(lengths), 9999)
    assert w.targets[w.scored].tolist() == ids.tolist()
    assert (w.inputs[:, 1:] == w.targets[:, :-1]).all()


def test_fast_scores_are_the_model():
    p = attention.initial(30)
    rng = np.random.default_rng(4)
    for k in ("wo", "w2", "bias"):
        p[k] = (rng.standard_normal(p[k].shape) * 0.5).astype(np.float32)
    classes, within = np.arange(30) % attention.CLASSES, rng.standard_normal(30).astype(np.float32)
    w = attention.windows(rng.integers(0, 29, 170), np.array([150, 20]), 29)
    e = attention.class_probs(p, attention.hidden(p, p["emb"][w.inputs]))
    e /= e.sum(axis=1, keepdims=True)
    y = w.targets.ravel()
    want = (np.log(e[np.arange(len(y)), classes[y]]) + within[y])[w.scored.ravel()]
    assert attention.log_scores(p, w, p["emb"], classes, within, 3) == pytest.approx(want, abs=1e-4)


def test_causal_and_normalised():
    p = attention.initial(30)
    rng = np.random.default_rng(2)
    p["wo"] = rng.standard_normal(p["wo"].shape).astype(np.float32)
    x = rng.standard_normal((1, 32, attention.DIM)).astype(np.float32)
    y = x.copy()
    y[0, 20:] = rng.standard_normal((12, attention.DIM))
    a, b = attention.hidden(p, x), attention.hidden(p, y)
    assert np.allclose(a[:20], b[:20], atol=1e-6) and not np.allclose(a[20:], b[20:])
    classes = np.arange(30) % attention.CLASSES
    begin, cont = scoring.refine(rng.integers(0, 9, (attention.CLASSES + 1, 31)).astype(float), classes)
    assert np.bincount(classes, np.exp(begin), attention.CLASSES)[:30] == pytest.approx(1.0, abs=1e-5)
    assert np.exp(cont).sum(axis=1) == pytest.approx(1.0, abs=1e-5)


def test_probabilities_sum_to_one(spark):
    """Of all texts of up to four words of a small vocabulary, known or not, the probabilities sum to 1 at most."""
    words = ["strawberryfields", "strawberry", "fields", "berry", "Straw"]
    texts = [" ".join(t) for n in range(5) for t in itertools.product(words, repeat=n)]
    train = ["strawberryfields"] * 1500 + ["strawberryfields fields"] * 300
    rows = [(i, t) for i, t in enumerate(train) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 5 == 1][: len(texts)]
    got = scoring.score_documents(spark.createDataFrame([*rows, *zip(held, texts)], "doc_id long, text string")).where("doc_id >= 10000").collect()
    p = {r.doc_id: 10**r.score for r in got}
    assert len(p) == len(texts) and 0.6 < sum(p.values()) <= 1.0
    assert p[held[1]] > 0.3


def test_scores_by_plain_loops(spark):
    """Scores against a loop over tokens: the definition, window by window, without tables or chunks."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["The", "river", "runs", "slowly,", "über", "stones."]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    df = docs(spark, texts)
    keep = scoring.Scratch(spark, "t")
    model, _, _ = scoring.fit(scoring.with_row_ids(df, keep), keep)
    own = scoring.Words(model.path, model)
    n, known, _, got, others = scoring.score(model, own, scoring.pa.array(texts))
    for k in range(len(texts)):
        ws = [*texts[k].translate(LOWER).split(), ""]
        want = 0.0
        for at, word in enumerate(ws):
            begin = 0 if at < attention.WINDOW else (at - attention.WINDOW) // attention.STRIDE * attention.STRIDE + attention.STRIDE
            row = lambda w: model.params["emb"][own.subwords(np.array([own[w]]))[0]].mean(axis=0)
            x = np.stack([row(ws[j - 1]) if j else row("") for j in range(begin, at + 1)])[None]
            e = attention.class_probs(model.params, attention.hidden(model.params, x)[-1:])[0]
            ids = own.subwords(np.array([own[word]]))[0].tolist()
            cls = model.classes[ids[0]]
            lp = float(model.begin[ids[0]]) + (sum(float(model.cont[model.slots[a], b]) for a, b in zip(ids, [*ids[1:], -1])) if word else 0.0)
            mass = sum(c for w, c in model.hot.items() if model.classes[own.subwords(np.array([own[w]]))[0][0]] == cls)
            types = sum(model.classes[own.subwords(np.array([own[w]]))[0][0]] == cls for w in model.hot)
            assert word in model.hot and not len(others[k])
            want += math.log10(e[cls] / e.sum() * ((model.hot[word] - 0.75) / mass + 0.75 * types / mass * math.exp(lp)))
        assert got[k] == pytest.approx(want, abs=2e-3) and n[k] == len(ws)


def test_cores_do_not_matter(spark, monkeypatch):
    """Scores are the same however the rows are dealt out, with several trainers."""
    monkeypatch.setattr(scoring, "TRAINER_WORDS", 500)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["river", "runs", "slow", "stone", "under"]) for _ in range(40)) for _ in range(80)]
    path = f"file://{scoring.Scratch(spark, 't').base.removeprefix('file://')}"
    docs(spark, texts).repartition(1).write.parquet(path)
    df = spark.read.parquet(path)
    one = {r.doc_id: r.score for r in scoring.score_documents(df).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        two = {r.doc_id: r.score for r in scoring.score_documents(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[1])
    assert one == pytest.approx(two, rel=1e-9)


def test_scores(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["The", "River", "runs", "slowly,", "über", "Stones."]) + rng.choice(["", "", "ing"]) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    texts += [*TEXTS, "rare" + "ly" * 40]
    monkeypatch.setattr(scoring, "HOT_WORDS", 5)
    df = docs(spark, texts).repartition(3).withColumn("rare", F.lit(1))
    got = {r.doc_id: r for r in scoring.score_documents(df).collect()}
    low = [[*(t or "").encode().lower().split(), b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for i, ws in enumerate(low) if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(low):
        r = got[i]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 1e-9
    common = [i for i in range(150) if held[i]]
    assert sum(got[i].score for i in common) / sum(got[i].n_tokens for i in common) > -2.5
    monkeypatch.setattr(scoring, "HOT_WORDS", 1 << 17)
    again = {r.doc_id: r.score for r in scoring.score_documents(df).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, rel=1e-6)  # hot or not, a word's share is the same
    assert scoring.score_documents(df.limit(0)).count() == 0


def test_pilot(spark, monkeypatch):
    """One very long text doesn't empty the start's sample, and the sample doesn't depend on the order of rows."""
    monkeypatch.setattr(scoring, "PILOT_BYTES", 6400)
    texts = ["long " * 3000, *(f"{w} stone river" for w in "abcdefghij"), None]
    df = docs(spark, texts).coalesce(1)
    got = scoring.pilot(df, len(texts))
    assert len(got) == len(texts) and 0 < max(map(len, got)) <= 100
    assert scoring.pilot(df.orderBy(F.desc("doc_id")), len(texts)) == got


def test_trainers_see_all_words(spark, monkeypatch):
    """Every word and end of the training fold is a target of a gradient step, once."""
    path, seen = scoring.default_tokenizer(), Counter()
    texts = [" ".join(f"w{i} stone{k % 7}" for k in range(600 + i)) for i in range(3)] + ["", None, "short one"]
    sent = type("Sent", (), {"value": scoring.start_of([], path)})
    gradients = attention.gradients

    def counted(p, x, y, scored):
        seen.update(y[scored].tolist())
        return gradients(p, x, y, scored)

    monkeypatch.setattr(attention, "gradients", counted)
    batch = scoring.pa.RecordBatch.from_arrays([scoring.pa.array([0, 0, 0, 1, 1, 1]), scoring.pa.array(texts)], names=["of", "text"])
    out = list(scoring.trainer(sent, 7)(iter([batch])))
    words = scoring.Words(path)
    numbers, lens, _, _ = words.numbers(scoring.pa.array(texts))
    assert seen == Counter((words.flat[words.start[numbers]] % attention.CLASSES).tolist())
    assert [b.column(1)[0].as_py() for b in out] == [0, 1] and [b.column(2)[0].as_py() for b in out] == [lens[:3].sum(), lens[3:].sum()]


def test_trainers_without_pilot(spark, monkeypatch):
    """The trainers run even if the pilot gives nothing."""
    monkeypatch.setattr(scoring, "pilot", lambda *a: [])
    keep = scoring.Scratch(spark, "t")
    model, _, _ = scoring.fit(scoring.with_row_ids(docs(spark, ["The river runs slowly, the stones stay."] * 40), keep), keep)
    assert np.abs(model.params["wo"]).max() > 0


def test_start_from_all_words(spark, monkeypatch):
    """Classes, slots and the weights' start come from counts of all training words, not from a sample."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "river", "runs", "slowly,", "über", "strawberryfields"]) + rng.choice(["", "", "ing"]) for _ in range(rng.randrange(0, 90))) for _ in range(90)] + [None, ""]
    path, got = scoring.default_tokenizer(), []
    monkeypatch.setattr(scoring, "pilot", None)
    monkeypatch.setattr(scoring, "COUNT_BYTES", 500)
    start_of = scoring.start_of
    monkeypatch.setattr(scoring, "start_of", lambda *a: got.append((a, start_of(*a))) or got[-1][1])
    keep, rows = scoring.Scratch(spark, "t"), docs(spark, texts).repartition(3)
    model, _, _ = scoring.fit(scoring.with_row_ids(rows, keep), keep)
    (beside, _, inside, places), start = got[-1]
    enc, vocab, end, k = scoring.encoding(path)[0], scoring.vocabulary(path), scoring.vocabulary(path) - 1, attention.CLASSES
    train = [[*(enc.encode_ordinary(" " + w) for w in (t or "").translate(LOWER).split()), [end]] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    first = Counter(w[0] for t in train for w in t)
    top = sorted(first, key=lambda i: (-first[i], i))[: scoring.CONTEXTS - 1]
    assert {i: places[i] for i in top} == {i: j for j, i in enumerate(top)}
    want, within = Counter(), Counter((vocab * k + i) for t in train for i in [w[0] for w in t])
    for t in train:
        for j, word in enumerate(t):
            for i in word:
                want[i * 2 * scoring.CONTEXTS + places[t[j - 1][0]]] += 1
                want[i * 2 * scoring.CONTEXTS + scoring.CONTEXTS + places[t[(j + 1) % len(t)][0]]] += 1
            if word != [end]:
                within.update(a * k + (b % (k - 1) if b >= 0 else k - 1) for a, b in zip(word, [*word[1:], -1]))
    assert {i: beside[i] for i in np.flatnonzero(beside).tolist()} == want
    assert {i: inside[i] for i in np.flatnonzero(inside).tolist()} == within
    assert (model.classes == start.classes).all() and (model.slots == start.slots).all() and len(set(model.classes[list(first)].tolist())) > 1


def test_rows_by_distinct_word(monkeypatch):
    """Within a turn each distinct word's mean is taken once, and the subwords' gradient is the sum over all positions."""
    path, made, seen, sent = scoring.default_tokenizer(), [], [], []
    means, gradients = scoring.means, attention.gradients
    monkeypatch.setattr(scoring, "means", lambda emb, ids, own, counts: made.append(len(counts)) or means(emb, ids, own, counts))
    monkeypatch.setattr(attention, "gradients", lambda *a: seen.append(gradients(*a)) or seen[-1])
    monkeypatch.setattr(attention.Adam, "step", lambda self, g, rate: sent.append(g) if "emb" in g else None)
    words = scoring.Words(path)
    numbers, lens, _, _ = words.numbers(scoring.pa.array([" ".join(f"strawberryfields{k % 5} stone" for k in range(n)) for n in (400, 7, 0, 3000)]))
    model = scoring.start_of([], path)
    fitter = scoring.Fitter(model.params, words, model.classes)
    fitter.fit(numbers, lens, np.random.Generator(np.random.PCG64(1)), 0.001)
    assert len(made) == len(sent) == 1 and made[0] <= 7 and len(seen) > 1
    w = attention.windows(numbers, lens, 0, stride=attention.WINDOW)
    deal = np.random.Generator(np.random.PCG64(1)).permutation(len(w.inputs))
    want = np.zeros_like(model.params["emb"], dtype=np.float64)
    for number, row in zip(w.inputs[deal].ravel(), np.concatenate([g["rows"] for _, g in seen])):
        ids = words.subwords(np.array([number]))[0]
        np.add.at(want, ids, row / len(ids))
    assert sent[0]["emb"] == pytest.approx(want, abs=1e-6)


def test_words_by_arrow(monkeypatch):
    """Words get their numbers and subwords without becoming Python strings, each once; numbers follow the order in which they come."""
    path, asked, seen = scoring.default_tokenizer(), [], {"": 0}
    encode = scoring.encode_words
    monkeypatch.setattr(scoring, "encode_words", lambda path, new: asked.append(new) or encode(path, new))
    words = scoring.Words(path)
    texts = ["The a\u00a0b river", "", None, "x\x1cy don't THE ü", *(f"w{i} stone{i % 3} river" for i in range(40)), "y" * 400 + " \U0001f600"]
    for k in range(0, len(texts), 9):
        part = texts[k : k + 9]
        numbers, lens, names, at = words.numbers(scoring.pa.array(part, scoring.pa.string()))
        low = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""] for t in part]
        want = [seen.setdefault(w, len(seen)) for t in low for w in t]
        assert numbers.tolist() == want and lens.tolist() == list(map(len, low))
        assert [names[i].as_py() if i >= 0 else "" for i in at.tolist()] == [w for t in low for w in t]
    assert all(isinstance(new, scoring.pa.Array) for new in asked)
    assert [w for new in asked for w in new.to_pylist()] == list(seen)[1:]
    for w, n in seen.items():
        assert words[w] == n
        assert words.subwords(np.array([n]))[0].tolist() == (scoring.encoding(path)[0].encode_ordinary(" " + w) if w else [words.end])


def test_words_that_come_again_stay(monkeypatch):
    """Forgetting keeps the words that came again, which are encoded once, and changes no score; what is kept is bounded."""
    path = scoring.default_tokenizer()
    vocab, k = scoring.vocabulary(path), attention.CLASSES
    model = scoring.start_of([], path)
    model.begin, model.cont = scoring.refine(np.ones((k + 1, vocab + 1)), model.classes)
    model.mass, model.left, model.hot = np.full(k, 50.0), np.full(k, 0.5), {"river": 9, "": 4, "w3": 2}
    texts = [f"The river{'s' * (i % 3)} w{i} x{i} strawberryfields stone {'longer' * 30}" for i in range(60)]
    encode, asked, most = scoring.encode_words, [], []
    monkeypatch.setattr(scoring, "encode_words", lambda path, new: asked.append(new) or encode(path, new))

    def scores() -> list:
        asked.clear()
        words, out = scoring.Words(path, model), []
        for i in range(0, 60, 3):
            n, known, base, s, others = scoring.score(model, words, scoring.pa.array(texts[i : i + 3]))
            out.append((n.tolist(), known.tolist(), base.tolist(), s.tolist(), others.to_pylist()))
            most.append(words.n)
        return out

    want = scores()
    once = Counter(w for new in asked for w in new.to_pylist())
    assert set(once.values()) == {1} and most[-1] == len(once) + 1 == 128
    monkeypatch.setattr(scoring, "CACHE_WORDS", 30)
    most.clear()
    assert scores() == want and max(most) <= 30 + 13
    again = Counter(w for new in asked for w in new.to_pylist())
    assert again == once
    monkeypatch.setattr(scoring, "CACHE_BYTES", 100)
    most.clear()
    assert scores() == want and max(most) <= 14


def test_means_of_subwords():
    """Means of words' rows, short words and long ones, against one word after another."""
    rng = np.random.default_rng(3)
    counts = np.array([1, 2, 16, 17, 3, 400, 1, 18, 5])
    ids, own, emb = rng.integers(0, 50, counts.sum()), np.cumsum(counts) - counts, rng.standard_normal((50, attention.DIM)).astype(np.float32)
    want = np.stack([emb[ids[a : a + n]].astype(np.float64).mean(axis=0) for a, n in zip(own, counts)])
    assert scoring.means(emb, ids, own, counts) == pytest.approx(want, abs=1e-5)
    assert scoring.means(emb, ids[:0], own[:0], counts[:0]).shape == (0, attention.DIM)


def test_ids_by_number(monkeypatch):
    """Ids found by words' numbers are those of whole texts, each new word is encoded once, and forgetting changes nothing."""
    path, asked = packing.default_tokenizer(), []
    known = packing.WordIds(path)
    encoded = known.encoded
    monkeypatch.setattr(known, "encoded", lambda new: asked.extend(new) or encoded(new))
    texts = [*TEXTS, "", None, "don't Ünder x (stone), stone. STONE \U0001f600!", *(f"w{i} stone{i % 3}, rivers" for i in range(90))]

    def check() -> None:
        for k in range(0, len(texts), 7):
            seq, bounds = packing.text_ids(known, scoring.pa.array(texts[k : k + 7], scoring.pa.string()))
            for t, a, b in zip(texts[k : k + 7], bounds, bounds[1:]):
                assert seq[a:b].tolist() == known.tok.encode(t or "", add_special_tokens=False).ids

    check()
    once = len(asked)
    assert once == len(set(asked)) > 90
    check()
    assert len(asked) == once
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    check()
    assert len(asked) > once and len(known.place) <= 20 + 7 * max(len((t or "").split()) for t in texts)


def test_far_rows_stay_finite():
    """Rows that lie far out give finite probabilities and gradients."""
    p = attention.initial(30)
    p["emb"] *= 100
    rng = np.random.default_rng(5)
    w = attention.windows(rng.integers(0, 29, 170), np.array([150, 20]), 29)
    classes = np.arange(30) % attention.CLASSES
    loss, g = attention.gradients(p, p["emb"][w.inputs], classes[w.targets], w.scored)
    assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())
    assert np.isfinite(attention.log_scores(p, w, p["emb"], classes, np.zeros(30))).all()
