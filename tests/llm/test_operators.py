"""The operators against brute force, exact round trips, SQL or held-out labels."""

import hashlib
import math
import random
import re
import time
import zlib
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import chat, decontaminate, lines, media, packing, pages, quality, secrets, simhash, token_counts
from ledgerline.llm.common import sized
from tests.conftest import same_rows

TEXTS = st.text(st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from(" \n\t'.,ab12<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


# --- 1: media ---------------------------------------------------------------------------------


def test_avi_round_trip_and_general_decoder():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40):
        payload = rng.integers(0, 256, media.FRAME * n, dtype=np.uint8).tobytes()
        data = media.encode_samples(payload)
        fps, frames = media.decode_samples(data)
        assert fps == media.FPS and frames.tobytes() == payload
        _, starts, sizes = media.parse_avi(data)
        for k in range(0, n, 13):
            pixels = media.decode_jpeg(data[starts[k] : starts[k] + sizes[k]])
            assert (pixels == np.kron(frames[k].reshape(media.HIGH, media.WIDE), np.ones((8, 8), int))).all()
        cut = data[: data.index(b"idx1")]  # without an index the chunks are walked
        assert media.decode_samples(cut)[1].tobytes() == payload


def test_clips_of_a_file(spark):
    payload = b"".join(bytes([level]) * media.FRAME * n for level, n in ((20, 25), (220, 50), (90, 5)))
    files = [(1, media.encode_samples(payload)), (2, None), (3, b"RIFF....AVI nothing"), (None, media.encode_samples(bytes(media.FRAME)))]
    got = media.clips(spark.createDataFrame(files, "doc_id bigint, media binary")).collect()
    want = [(1, 0, 0, 25, 0.0, 1.0, 20.0), (1, 1, 25, 50, 1.0, 3.0, 220.0), (1, 2, 75, 5, 3.0, 3.2, 90.0), (2, *[None] * 6), (3, *[None] * 6), (None, 0, 0, 1, 0.0, 0.04, 0.0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_features_of_the_query_by_recount(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op1_media_avi(spark, sf).collect():
        raw = media.padded(texts[r["doc_id"]])
        frames = [raw[k : k + 192] for k in range(0, len(raw), 192)]
        hist = [[sum(b >> 4 == k for b in f) / 192 for k in range(16)] for f in frames]
        d = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2 for x, y in zip(hist, hist[1:])]
        cuts = [0]
        for k, x in enumerate(d):
            near = d[max(0, k - 8) : k] + d[k + 1 : k + 9]
            middle = float(np.median(near)) if near else 0.0
            spread = 1.4826 * float(np.median([abs(n - middle) for n in near])) if near else 0.0
            if x >= 0.35 and x > middle + 2.5 * spread:
                cuts.append(k + 1)
        assert r["feature"] == f"frames={len(frames)};shots={len(cuts)};at={','.join(f'{c / 25:.2f}' for c in cuts)}"
        data = media.encode_samples(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())


def test_standard_tables_serve_frames_without_any():
    assert {k: len(v) for k, v in media.STANDARD.items()} == {0x00: 12, 0x01: 12, 0x10: 162, 0x11: 162}
    pairs = {run << 4 | size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0}
    assert set(media.STANDARD[0x10].values()) == set(media.STANDARD[0x11].values()) == pairs
    # one grey block of 8 x 8: the standard's code for a difference of category 6 is 1110, for the end of a block 1010
    level = 40
    bits = "1110" + format(level, "06b") + "1010"
    scan = int((bits + "1" * (-len(bits) % 8)), 2).to_bytes(-(-len(bits) // 8), "big")
    quant = media.segment(0xDB, b"\x00" + bytes([8] * 64))
    frame = media.segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + media.segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    assert (media.decode_jpeg(b"\xff\xd8" + quant + frame + scan + b"\xff\xd9") == 128 + level).all()


def test_broken_files_only_raise_value_errors():
    rng, good = random.Random(3), media.encode_samples(bytes(range(192)) * 6)
    for k in range(600):
        data = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randrange(1, len(data))] if k % 3 == 0 else data)
        try:
            media.decode_samples(data)
        except ValueError:
            pass
    large = good.replace(bytes([8, 0, media.HIGH * 8, 0, media.WIDE * 8]), bytes([8, 255, 255, 255, 255]))
    assert large != good
    with pytest.raises(ValueError):
        media.decode_samples(large)


def test_zigzag_is_a_diagonal_walk():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.ZIGZAG) == list(range(64))


def test_shots_start_where_the_picture_changes():
    rng = np.random.default_rng(2)
    dark, light = rng.integers(10, 60, (30, 192), dtype=np.uint8), rng.integers(180, 250, (20, 192), dtype=np.uint8)
    assert media.shot_starts(np.concatenate([dark, light, dark])).tolist() == [0, 30, 50]


def test_cuts_of_short_files_and_quick_cuts():
    dark, light = np.full((1, 192), 20, np.uint8), np.full((1, 192), 220, np.uint8)
    shot = lambda *sizes: np.concatenate([np.repeat((dark, light)[k % 2], n, axis=0) for k, n in enumerate(sizes)])
    for n in range(2, 10):
        for at in {1, n // 2, n - 1}:
            assert media.shot_starts(shot(at, n - at)).tolist() == [0, at]
    assert media.shot_starts(shot(20, 2, 2, 20)).tolist() == [0, 20, 22, 24]
    assert media.shot_starts(shot(20, 2, 2, 2, 2, 20)).tolist() == [0, 20, 22, 24, 26, 28]


def test_media_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op1_media_avi(spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


# --- 2: quality -------------------------------------------------------------------------------


def test_quality_matches_sql(spark, sf, duck):
    same_rows(quality.op2_quality(spark, sf), duck.execute(quality.quality_sql()))


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    keep = {r["doc_id"]: r["keep"] for r in quality.op2_quality(spark, sf).collect()}
    rows = [(keep[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    good, bad = [k for k, q in rows if q == 1], [k for k, q in rows if q == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1


def kneser_ney(trusted: list[str], text: str, order: int) -> float:
    """Minus the log probability of ``text``, by the formulas and dictionaries, rounded as the model is."""
    from collections import Counter, defaultdict

    pad = quality.START * (order - 1)
    grams = lambda t: [(pad + t)[i : i + order] for i in range(len(t))]
    level = Counter(g for t in trusted for g in grams(t))
    levels = [level]
    while len(levels) < order:
        level = Counter(g[1:] for g in level)
        levels.insert(0, level)
    cuts = []
    for level in levels:
        d = quality.discounts([sum(v == i for v in level.values()) for i in (1, 2, 3, 4)])
        cuts.append(lambda n, d=d: d[min(n, 3) - 1])
    total1, even = sum(levels[0].values()), sum(map(cuts[0], levels[0].values())) / sum(levels[0].values()) / (len(levels[0]) + 1)
    p = [{g: even + (n - cuts[0](n)) / total1 for g, n in levels[0].items()}]
    weight = [{}]
    for k in range(1, order):
        total, left = defaultdict(int), defaultdict(float)
        for g, n in levels[k].items():
            total[g[:-1]] += n
            left[g[:-1]] += cuts[k](n)
        weight.append({u: left[u] / total[u] for u in total})
        p.append({g: (n - cuts[k](n)) / total[g[:-1]] + weight[k][g[:-1]] * p[k - 1][g[1:]] for g, n in levels[k].items()})
    units = lambda x: round(math.log(x) * quality.UNIT)

    def value(g: str) -> int:
        if g in p[len(g) - 1]:
            return units(p[len(g) - 1][g])
        return units(even) if len(g) == 1 else units(weight[len(g) - 1].get(g[:-1], 1)) + value(g[1:])

    return -sum(map(value, grams(text)))


@pytest.mark.parametrize(("block", "askers"), [(quality.BLOCK, quality.ASKERS), (60, 1)])
def test_perplexity_by_dictionaries(spark, block, askers, monkeypatch):
    monkeypatch.setattr(quality, "SHARD", 50)
    rng = random.Random(4)
    words = ["river", "green", "hill", "ran", "tö", "日本", "the", "of", "\x02", "🙂"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 15))) for _ in range(40)] + ["", "unseen Ж %%", texts_twice := "the river ran", texts_twice]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "of the hill", "en")] * 2 + [(2**62 + 1, "the ran", None)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    for order in (2, 4) if askers > 1 else (4,):
        got = quality.perplexities(docs, labels, order, block, askers).collect()
        train = [texts[r["doc_id"]] for r in quality.label_folds(labels).collect() if not r["held"]]
        want = sorted(((d, kneser_ney(train, t, order)) for d, t, _ in rows), key=str)
        assert sorted(((r["doc_id"], r["nll"]) for r in got), key=str) == want


def test_threshold_is_the_quantile_of_held_out_scores(spark):
    words = "the old river ran past green hills and small towns until it met a wide grey sea".split()
    rows = [(k, " ".join(words[(k * j) % len(words)] for j in range(1, 30 + k)), "en") for k in range(1, 301)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id bigint, quality int, toxic int")
    out = quality.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels).collect()
    held = {r["doc_id"] for r in quality.label_folds(labels).collect() if r["held"]}
    scores = [r["score"] for r in out if r["doc_id"] in held]
    assert 30 < len(held) < 100 and {round(r["threshold"], 9) for r in out} == {round(float(np.quantile(scores, quality.QUANTILE)), 9)}


def test_languages_go_over_to_their_own_threshold_by_degrees(spark):
    words = "the old river ran past green hills and small towns until it met a wide grey sea".split()
    other = "le vieux fleuve passait par des collines vertes".split()
    lang = lambda k: "en" if k % 10 else "fr"
    rows = [(k, " ".join((words if k % 10 else other)[(k * j) % (15 if k % 10 else 8)] for j in range(1, 30 + k)), lang(k)) for k in range(1, 301)]
    docs = spark.createDataFrame([*rows, (900, "the old river", "de")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id bigint, quality int, toxic int")
    held = {r["doc_id"] for r in quality.label_folds(labels).collect() if r["held"]}
    limit = lambda out: {r["lang"]: r["threshold"] for r in out}
    for shrink in (0, quality.SHRINK, 1_000_000):
        out = quality.classify(docs, labels, shrink=shrink).collect()
        mean = lambda r: math.log(r["perplexity"])
        trusted = [r for r in out if r["doc_id"] in held]
        scores = {k: [r["score"] for r in trusted if r["lang"] == k] for k in ("en", "fr")}
        # the shared scores are drawn toward the shared median
        middle = float(np.median([round(mean(r), 3) for r in trusted]))
        shared = float(np.quantile([round((mean(r) * r["n_chars"] + quality.PRIOR * middle) / (r["n_chars"] + quality.PRIOR), 3) for r in trusted], quality.QUANTILE))
        got = limit(out)
        assert got["de"] == pytest.approx(shared, abs=2e-3)
        for k, own in scores.items():
            n = len(own)
            assert got[k] == pytest.approx((n * float(np.quantile(own, quality.QUANTILE)) + shrink * got["de"]) / (n + shrink), abs=2e-6)


def test_who_is_trusted_and_rows_without_ids(spark):
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, None, 0), (6, 1, 0), (6, 0, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0)]
    folds = quality.label_folds(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert sorted(r["doc_id"] for r in folds) == [1, 7]
    good = "the old river ran past the green hills and on to the sea. "
    rows = [(k, good * (1 + k % 3), "en") for k in range(1, 200)] + [(None, "%%## || @@!! " * 30, "en"), (None, good, "en"), (500, "%%## || @@!! " * 30, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = quality.keep_good(docs, spark.createDataFrame([(k, 1, 0) for k in range(1, 200)], "doc_id bigint, quality int, toxic int")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.where("text NOT LIKE '%##%'").collect()))


def test_discounts_by_hand():
    y = 10 / (10 + 2 * 5)
    assert quality.discounts([10, 5, 3, 2]) == [1 - 2 * y * 5 / 10, 2 - 3 * y * 3 / 5, 3 - 4 * y * 2 / 3]
    assert quality.discounts([1, 0, 0, 0]) == [0.5, 0.5, 0.5]


# --- 3: chat ----------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<|\\>im_n\nrt"), max_size=30))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_query(spark, sf):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    control = "<|im_end|><|im_start|>assistant ok"
    turns += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    want = {}
    for conv, _, role, text in sorted(turns):
        w = want.setdefault(conv, [0, "", ""])
        w[0], w[1], w[2] = w[0] + 1, w[1] + f"{role}\n{text}\n", w[2] + (text if role == "assistant" else "")
    got = {r["conv_id"]: r for r in chat.op3_chat_format(spark, sf).collect()}
    assert set(got) == set(want)
    for conv, (n, every, learnt) in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (n, hashlib.sha256(every.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_offsets_and_masks(spark):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "yes, of course"), (1, 2, "assistant", "")]
    out = sorted(chat.format_chat(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect(), key=lambda r: r["turn_no"])
    assert [r["token_from"] for r in out] == [0, len(out[0]["ids"]), len(out[0]["ids"]) + len(out[1]["ids"])]
    assert [any(r["loss_mask"]) for r in out] == [False, True, False]
    assert all(len(r["ids"]) == len(r["loss_mask"]) for r in out)


# --- 4: pages ---------------------------------------------------------------------------------


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home, now</a></nav>
<div class="cookie-notice">We use cookies, as all do, and that is that.</div><div id=main><h1>Head &amp; shoulders</h1>
<p>First paragraph, with&nbsp;some <b>bold</b>  words. It goes on, and on.<p>Second paragraph; unclosed, too.<br>New line.</p><ul><li>one, point</li><li>two</li></ul></div>
<aside>Aside, a long text that could be content, but is not.</aside><section class="comments"><p>A comment, long and full of words, that a reader wrote. Really, yes.</p></section>
<form><label>Name</label><input></form><footer>Copyright, all rights reserved.</footer></body></html>"""


ARTICLE = "Head & shoulders\nFirst paragraph, with some bold words. It goes on, and on.\nSecond paragraph; unclosed, too. New line.\none, point\ntwo"


def test_article_of_a_page():
    assert pages.extract(PAGE) == ARTICLE


def test_pages_query(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").join(pages.op4_page_text(spark, sf).select("page_id", "text", "n_chars"), "page_id").collect():
        article = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|article)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_path_weights_prefer_long_punctuated_text():
    nodes = [(0, "x")] * 5 + [(1, "A sentence, and more of it. " * 4)] * 3 + [(2, "end")]
    weight, threshold = pages.path_weights(nodes)
    assert weight[1] >= threshold > weight[2]
    assert pages.path_weights(nodes, {1})[0][1] == weight[1] * pages.DEMERIT


def paragraphs(rng, n):
    words = "the old river ran past green hills and small towns until it met a wide grey sea".split()
    return [" ".join(rng.choices(words, k=rng.randint(12, 60))).capitalize() + ", and so on. It ended." for _ in range(n)]


def page_of_plain_blocks(rng) -> tuple[str, str]:
    """A page whose elements have no telling names: menus and the article in nested blocks."""
    body = [f"<h2>{rng.choice(['Rivers', 'Hills'])}</h2>", *(f"<p>{p}</p>" for p in paragraphs(rng, rng.randint(3, 9)))]
    links = lambda n: "".join(f"<span><a href=/{i}>go {i}</a></span>" for i in range(n))
    depth = rng.randint(1, 3)
    html = f"<body><div><div>{links(rng.randint(3, 9))}</div></div>{'<div>' * depth}{''.join(body)}{'</div>' * depth}<div><div>{links(4)}</div><div>All rights</div></div></body>"
    return html, "\n".join(re.sub("<[^>]*>", "", b) for b in body)


def test_ratios_choose_the_article_without_lists(monkeypatch):
    rng = random.Random(6)
    cases = [page_of_plain_blocks(rng) for _ in range(60)]
    assert [pages.extract(h) for h, _ in cases] == [t for _, t in cases]
    monkeypatch.setattr(pages, "path_weights", lambda nodes, marked=frozenset(): ({p: 1.0 for p, _ in nodes}, 0.0))
    assert all(pages.extract(h) != t for h, t in cases) and pages.extract(PAGE) != ARTICLE


def test_body_text_with_odd_names_stays():
    rng = random.Random(7)
    text = paragraphs(rng, 3)
    html = f"""<body><header><a>Site</a></header><article><header><h1>Head line</h1></header><p>{text[0]}</p><figure><img src=x><figcaption>A caption.</figcaption></figure>
<p class="legal-history">{text[1]}</p><div class="search-engine-history"><p>{text[2]}</p></div><section id="comments-list"><p>{text[0]}</p></section></article><footer>End.</footer></body>"""
    assert pages.extract(html) == "\n".join(["Head line", text[0], "A caption.", text[1], text[2]])
    deep = "<body>" + "<div>" * 900 + "<nav><a>Home</a> and more, of it.</nav>" + f"<article><p>{text[0]}</p><aside>{'<div>' * 600}x{'</div>' * 600} tail of the aside</aside></article>" + "</div>" * 900
    assert pages.extract(deep) == text[0]
    assert pages.extract("<nav>Only a menu, here.</nav>") == "" and pages.extract(f"<p>a\x85b\u1680c &#160; {text[0]}") == f"a b c {text[0]}"
    assert pages.extract(f"<p>{text[0]}</></ x><b title='a>b'>bold</b> 1 < 2 <a href=\"never closed>link</a></p>") == f"{text[0]}bold 1 < 2 link"


def test_hostile_pages_take_linear_time():
    import time

    for html in ("<a " * 350_000 + '"', "<p>x" + "<b>" * 80_000 + "<p></p>" * 80_000, "<div>" * 90_000 + "text" + "</div>" * 90_000, "<a href='x>" * 90_000 + '"<p>end</p>', "<li>x" * 80_000):
        began = time.time()
        pages.extract(html)
        assert time.time() - began < 20


# --- 5: SimHash -------------------------------------------------------------------------------


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    """fp -> smallest representative reachable by links of 3 or fewer bits."""
    keys = list(fps)
    a = np.array([k & (1 << 64) - 1 for k in keys], np.uint64)
    label = np.array([fps[k] for k in keys])
    while True:
        new = np.array([label[np.bitwise_count(a ^ x) <= 3].min() for x in a])
        if (new == label).all():
            return dict(zip(keys, label.tolist(), strict=True))
        label = new


@pytest.mark.parametrize(("dense", "dense_from", "block"), [(0, 8, 2048), (300, 8, 2048), (300, 1, 16)])
def test_links_lose_nothing(spark, dense, dense_from, block):
    rng = random.Random(dense)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = set(centres) | {0}
    for _ in range(300):
        fps.add(rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    for _ in range(dense):  # a family around one centre: its anchors are compared in blocks
        fps.add(centres[0] ^ sum(1 << b for b in rng.sample(range(10), rng.randint(1, 5))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    reps = dict(zip(signed, rng.sample(range(10_000), len(signed)), strict=True))
    df = spark.createDataFrame([(0, *x) for x in reps.items()], "lane int, fp bigint, rep bigint")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, dense_from, block)).collect()}
    want = {reps[k]: c for k, c in brute_components(reps).items()}
    assert {n: got.get(n, n) for n in want} == want


def test_simhash_query(spark, sf):
    import xxhash

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(len(words) - 2, min(len(words), 1)))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    docs = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    reps = {}
    for d in sorted(docs):
        reps.setdefault(docs[d], d)
    component = brute_components(reps)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op5_simhash(spark, sf).collect()} == {(d, f"{f:016x}", component[f]) for d, f in docs.items()}


def brute_lanes(docs: dict[int, list[int]]) -> dict[int, int]:
    """doc -> smallest doc reachable, where documents link if a half of a fingerprint differs in 1 bit at most, and all in 0.155 of their bits."""
    ids = np.array(sorted(docs))
    fps = np.array([docs[d] for d in ids.tolist()], np.int64).view(np.uint64)

    def near(i: int) -> np.ndarray:
        x = fps ^ fps[i]
        halves = np.minimum(np.bitwise_count(x >> np.uint64(32)), np.bitwise_count(x & np.uint64(0xFFFFFFFF))).min(axis=1)
        return (x == 0).all(axis=1) | (halves <= 1) & (np.bitwise_count(x).sum(axis=1) <= 0.155 * 64 * fps.shape[1])

    label = ids.copy()
    while True:
        new = np.array([label[near(i)].min() for i in range(len(ids))])
        if (new == label).all():
            return dict(zip(ids.tolist(), label.tolist(), strict=True))
        label = new


@pytest.mark.parametrize(("dense_from", "block"), [(simhash.DENSE, simhash.BLOCK), (1, 4)])
def test_lanes_find_more(spark, dense_from, block, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (dense_from, block, None))
    rng = random.Random(9)
    words = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in "lmnrst"]
    docs = {}
    for k in range(30):
        text = rng.choices(words, k=rng.randint(100, 300))
        for j in range(4):
            copy = list(text)
            for _ in range(2 * j):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs[10 * k + j] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5, 4).collect()}
    assert got == brute_lanes({d: simhash.fingerprint(t, 5, 4) for d, t in docs.items()})
    assert all(d // 10 == c // 10 for d, c in got.items())
    one = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, 5, 1).collect()}
    assert sum(d != c for d, c in got.items()) > 1.3 * sum(d != c for d, c in one.items())


# --- 6: packing -------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_sequences_hold_every_piece_once(lengths):
    bins = packing.fill_sequences(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 40 for b in bins)


def test_two_pieces_replace_the_smallest():
    assert [sorted([7, 2, 1][i] for i in b) for b in packing.fill_sequences([7, 2, 1], 10)] == [[1, 2, 7]]
    # greedy takes 6 + 3 and leaves a gap of 1; 2 + 2 fill the 4 that opens without the 3
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in packing.fill_sequences([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]


def test_two_pieces_replace_a_single_one():
    assert sorted(sorted([9, 6, 6][i] for i in b) for b in packing.fill_sequences([9, 6, 6], 12)) == [[6, 6], [9]]


def test_groups_stay_small_without_ids(spark):
    rows = [(None, 0, 0, 5, k) for k in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = packing.pack_pieces(pieces, 10, 100).collect()
    groups = [r["sequence_id"] >> 32 for r in out]
    assert sorted(r["ids_crc32"] for r in out) == list(range(600)) and max(map(groups.count, set(groups))) < 200


def test_packing_query(spark, sf):
    tok = token_counts.library(packing.default_path())
    docs = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op6_pack(spark, sf).collect()
    want = {(d, k, 4096 * k): ids[4096 * k : 4096 * (k + 1)] for d, ids in docs.items() for k in range(-(-len(ids) // 4096))}
    assert {(r["doc_id"], r["piece"], r["start"]) for r in rows} == set(want) and len(rows) == len(want)
    places = {}
    for r in rows:
        ids = want[r["doc_id"], r["piece"], r["start"]]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1.02 * sum(map(len, want.values())) / 4096 + 1


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoder_is_the_library(text):
    tok = token_counts.library(packing.default_path())
    got = np.frombuffer(packing.Encoder(packing.default_path()).encode(text), "<u4").tolist()
    assert got == tok.encode(text, add_special_tokens=False).ids


# --- 7: secrets -------------------------------------------------------------------------------


def test_base_spans():
    text = 'Password: "abcdefghijkl" token=secret: abcdefghijklmnop AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef api_key = short'
    kinds = [(secrets.KINDS[k], text[lo:hi]) for lo, k, hi in secrets.base_spans(text)]
    assert kinds == [("assign", 'Password: "abcdefghijkl'), ("access", "AKIAABCDEFGHIJKLMN"), ("hex", "0123456789abcdef")]


def entropy_by_recount(s: str) -> set[int]:
    """The places of findings, by the rules of the module's docstring and its fixed values, window by window."""
    allowed = [m.span() for m in re.finditer(r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefghij|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", s)]
    hit = set()
    for i in range(len(s) - 20 + 1):
        w = s[i : i + 20]
        if not re.search("[A-Za-z]", w) or any(a < i + 20 and i < b for a, b in allowed):
            continue
        least = 4.0 if not re.search("[0-9]", w) else 3.8 if re.search("[+/_=-]", w) else 3.5 if re.search("[g-zG-Z]", w) else 3.0
        h = -sum(w.count(c) / 20 * log2(w.count(c) / 20) for c in set(w))
        if h >= least - 1e-9:
            hit |= set(range(i, i + 20))
    return hit


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("abcdefXYZghijk0123456789+/_-"), max_size=30), st.sampled_from(["dummy", "Example", "0123456789"])), max_size=4).map("".join))
def test_entropy_windows_by_recount(s):
    assert {p for lo, hi in secrets.entropy_spans(s) for p in range(lo, hi)} == entropy_by_recount(s)


def test_an_allowed_word_hides_its_windows_only():
    key = "k8Jq2LmZp0Xv7RtYw3Bn"
    assert secrets.entropy_spans(key) == [(0, 20)]
    assert secrets.entropy_spans(key + "dummy" + key) == [(0, 20), (25, 45)] and secrets.entropy_spans("QwErTyUiOpAsDfGhJkLzXcVbNmPoIu")
    assert secrets.entropy_spans("a_rather_long_variable_name_2024") == [] and secrets.entropy_spans("1234567890-1234567890-12") == []


def test_long_candidates_take_linear_time():
    seconds = {}
    for n in (50_000, 400_000):
        for text in ("0123456789abcdefghij" * (n // 20), "0123456789abcdefghijKLMNOPQRSTUVWXYZ98765+/qwertZUIOP" * (n // 53)):
            began = time.time()
            secrets.all_spans(text)
            seconds[n, text[20:21]] = time.time() - began
    assert all(seconds[400_000, c] < 25 * seconds[50_000, c] + 0.5 for _, c in seconds)


def test_secrets_query(spark, sf):
    rows = {r["doc_id"]: r for r in secrets.op7_secret_scan(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t, spans = d["text"] or "", []
        pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        spans += [(m.start(), 0, m.end()) for m in re.finditer(pattern, t, re.I | re.A) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        r = rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def test_all_spans_of_the_query(spark, sf):
    rows = {r["doc_id"]: r["spans"] for r in secrets.op7_secret_scan(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = d["text"] or ""
        want = {m.start() + p for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t) for p in entropy_by_recount(m[0])}
        spans = [x.split(":") for x in rows[d["doc_id"]].split(",") if x.startswith("entropy")]
        assert {p for _, lo, hi in spans for p in range(int(lo), int(hi))} == want


# --- 8 and 9: lines and leaks -----------------------------------------------------------------


def test_lines_match_sql(spark, sf, duck):
    same_rows(lines.op8_line_dedup(spark, sf), duck.execute(lines.line_dedup_sql()))


def test_templates_generalise(spark):
    base = "the server at node {} answered the request of user {} in good time today"
    rows = [(1, base.format(7, "anna")), (2, base.format(9, "bert") + "\nonly here is this line said"), (3, base.format(3, "carl")), (4, "the server at node seven was never heard of again by anyone of us")]
    out = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {1: rows[0][1], 2: "only here is this line said", 3: "", 4: rows[3][1]}


def test_large_tables_are_shuffled_with_the_same_result(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    runs = []
    for rows in (1_000_000, 0):
        for module in (lines, quality):
            monkeypatch.setattr(module, "sized", lambda df, n=0, rows=rows: sized(df, rows))
        runs.append([sorted(map(str, lines.drop_recurring_lines(docs, broadcast_rows=rows).collect())), sorted(r["doc_id"] for r in quality.keep_good(docs, labels).collect())])
    assert runs[0] == runs[1] and len(runs[0][1]) < docs.count()


def test_a_leaf_holds_several_templates(spark):
    rng = random.Random(5)
    words = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u")]
    lead = "the server at node "
    families = ["one answered the request of user {} in good time today", "two was seen by {} and then went out for ever", "four has {} on the list of all that ever was"]
    texts = [lead + f.format(w) for f in families for w in rng.sample(words, 6)]
    texts += [lead + " ".join(rng.sample(words, 11)) for _ in range(30)]  # unrelated lines of the same leaf
    assert len({len(x.split()) for x in texts}) == 1
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs).collect()}
    stay = {1, 7, 13} | set(range(19, 49))
    assert {d for d, t in out.items() if t} == stay and all(out[d] == dict(rows)[d] for d in stay)
    every = {r["doc_id"] for r in lines.drop_recurring_lines(docs, everywhere=True, broadcast_rows=0).collect() if r["text"]}
    assert every == set(range(19, 49))


def test_lines_of_odd_spaces_and_fields_match_sql(spark, duck):
    rng = random.Random(8)
    token = lambda: "".join(rng.choices("ab7é<*>", k=rng.randrange(1, 5)))
    line = lambda: "".join(t for _ in range(rng.randrange(7)) for t in (token(), rng.choice([" ", " ", "  ", "\t", "\r", " \r\t ", ""])))
    known = [line() for _ in range(150)]
    rows = [(i, None if i % 50 == 0 else "\n".join(rng.choice(["", " "]) + rng.choice(known) + rng.choice(["", "\r"]) for _ in range(rng.randrange(6)))) for i in range(400)]
    duck.register("odd_lines", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    same_rows(lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), counts=True), duck.execute(lines.line_dedup_sql("odd_lines")))


def test_a_text_of_many_lines_is_split_once(spark):
    own = [f"line {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]} of this text alone and of no other text" for i in range(10_000)]
    rows = [(1, "a line that comes again and again"), (2, "\n".join(["a line that comes again and again", *own]))]
    frame = lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), counts=True)
    began = time.time()  # of the last step alone
    out = {r["doc_id"]: r for r in frame.collect()}
    assert time.time() - began < 10
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "\n".join(own) and (out[2]["n_lines"], out[2]["n_dropped"]) == (10_001, 1)


def test_leaks_match_sql(spark, sf, duck):
    same_rows(decontaminate.op9_decontaminate(spark, sf), duck.execute(decontaminate.leaks_sql()))


def test_rows_without_ids_leak_too(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(None, f"say {item} now"), (None, "clean as ever it was before"), (1, item), (None, f"say {item} now")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, item), (4, item)], "item_id bigint, text string")
    for rows in (1_000, 0):  # broadcast or shuffled
        got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.leaks(docs, items, rows).collect())
        assert got == [("1", "4"), ("1", "None"), ("None", "4"), ("None", "None")]
        assert [r["text"] for r in decontaminate.without_leaks(docs, items, rows).collect()] == ["clean as ever it was before"]


def test_a_stock_phrase_makes_no_candidates(spark):
    rng = random.Random(1)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    stock = "which of the following statements is true about the"
    items = [(i, f"{stock} {own(12)}") for i in range(300)] + [(300, stock), (301, f"{stock} end")]
    docs = [(d, f"{own(20)} {stock} {own(20)}") for d in range(400)] + [(400, f"{own(5)} {items[7][1]} {own(5)}"), (401, stock)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    shingles = decontaminate.item_shingles(spark.createDataFrame(items, "item_id bigint, text string"))
    pairs = decontaminate.candidates(frame, decontaminate.sketches(shingles), [5]).collect()
    # the two items that are the phrase itself are in every document; the others in theirs only
    assert {(r["doc"], r["item"]) for r in pairs if r["item"] not in ("i300", "i301")} == {("i400", "i7")}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert found == {(400, 7)} | {(d, i) for d in range(402) for i in (300, 301)}


def test_leaks_by_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary[: rng.choice([3, 12])], k=rng.choice([1, 3, 5, 6, 9, 15, 40])))) for i in range(60)]
    docs = []
    for d in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((d, " ".join(rng.choices(vocabulary, k=3) + w + rng.choices(vocabulary, k=3))))
    grams = lambda t, n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    want = set()
    for i, text in items:
        mine = grams(text.split(), min(5, len(text.split())))
        n = len(next(iter(mine)))
        want |= {(d, i) for d, t in docs if len(grams(t.split(), n) & mine) >= 0.8 * len(mine)}
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 100


def test_short_items_and_edges(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, " ".join(f"w{i}" for i in range(24))), (3, "")], "item_id bigint, text string")
    words = [f"w{i}" for i in range(24)]
    docs = [(1, "x ALPHA\tbeta y"), (2, " ".join(words[:20])), (3, " ".join(words[:19])), (4, "pad " * 9000 + " ".join(words) + " pad" * 9000), (5, "alpha gamma beta")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (4, 2)}


# --- 10: token counts -------------------------------------------------------------------------


def test_every_safe_character():
    path = token_counts.default_path()
    counter = token_counts.Counter(path, token_counts.whole_tokens(path))
    texts = [f"ab{c}cd {c}{c} 12{c}3 -{c}- {c}" for c in map(chr, range(0x300))]
    assert list(map(counter.count, texts)) == [len(e) for e in counter.tok.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = packing.Encoder(packing.default_path())
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == [e.ids for e in encoder.tok.encode_batch_fast(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_counts_are_the_librarys(texts):
    path = token_counts.default_path()
    counter = token_counts.Counter(path, token_counts.whole_tokens(path))
    assert list(map(counter.count, texts)) == [len(counter.tok.encode(t, add_special_tokens=False)) for t in texts]


def test_caches_are_bounded_by_bytes():
    texts = ["".join(chr(0x4E00 + (i * 7919 + k) % 20_000) for k in range(5000)) for i in range(20)] + ["é" * 3000 + "x" * k for k in range(20)] + ["some plain words"]
    counter, encoder = token_counts.Counter(token_counts.default_path(), token_counts.whole_tokens(token_counts.default_path())), packing.Encoder(packing.default_path())
    tok = token_counts.library(token_counts.default_path())
    for t in texts:
        assert counter.count(t) == len(tok.encode(t, add_special_tokens=False).ids)
        encoder.encode(t)
    kept = [*counter.chunks, *counter.kept, *encoder.kept, *encoder.words]
    assert 0 < max(map(len, kept)) <= token_counts.SHORT and len(kept) < 50


def test_token_query(spark, sf):
    tok = token_counts.library(token_counts.default_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.op10_token_counts(spark, sf).collect():
        n = len(tok.encode(texts[r["doc_id"]], add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)
