"""Small cases against brute force: nulls, empty and equal texts, repeated rows, clashing extra columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, html_extract, lm_scoring, minhash_dedup, mixing, sentencepiece_codec, suffix_dedup, topk_search, url_filter

BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, BASE), (2, BASE + " x"), (3, BASE), (4, None), (5, ""), (6, "two words"), (7, "Two  WORDS"), (None, BASE), (8, BASE), (8, BASE), (9, "é " * 50), (10, "zz " * 300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, "src" if a and a % 2 else None, 1, 2) for a, b in ROWS], "doc_id long, text string, source string, id int, n int")


def test_exact_copies(docs):
    for moduli in (exact_dedup.MODULI, (3, 2)):  # weak moduli: the comparison of chunks must tell texts apart
        for huge in (exact_dedup.HUGE_BYTES, 100):
            got = exact_dedup.find_copies(docs, moduli=moduli, huge_bytes=huge).collect()
            assert len(got) == len(ROWS)
            for r in got:
                same = [(a, b) for a, b in ROWS if hashlib.sha256((b or "").encode()).hexdigest() == r["sha"]]
                assert r["group_size"] == len(same) and r["keep_id"] == max(a for a, _ in same if a is not None)
            assert sum(r["kept"] for r in got) == len({b or "" for _, b in ROWS})
    assert exact_dedup.drop_copies(docs).count() == len({b or "" for _, b in ROWS})
    assert exact_dedup.find_copies(docs.limit(0)).count() == 0


def test_fingerprints_combine():
    data = bytes(range(256)) * 300
    p = exact_dedup.MODULI[0]
    whole = exact_dedup.fingerprint(data) >> 31
    assert sum(exact_dedup._shares(data[at : at + exact_dedup.CHUNK], max(0, len(data) - at - exact_dedup.CHUNK))[0] for at in range(0, len(data), exact_dedup.CHUNK)) % p == whole


def test_near_copies(docs):
    got = {(r["id"], r["n_shingles"]): r["component_id"] for r in minhash_dedup.find_near(docs, words=3, percent=85).collect()}
    assert got[1, 58] == got[2, 59] == got[3, 58] == got[8, 58] and got[6, 1] == got[7, 1] == 6 and got[4, 0] == 4 and got[5, 0] == 5


def test_repeats(docs):
    got = suffix_dedup.remove_repeats(docs, length=40).collect()
    texts = [(b or "").encode() for _, b in ROWS]
    for r in got:
        text = next((b or "").encode() for a, b in ROWS if a == r["id"])
        gone = bytearray(len(text))
        for i in range(len(text) - 39):
            w = text[i : i + 40]
            if sum(sum(t[j : j + 40] == w for j in range(len(t) - 39)) for t in texts) > 1:
                gone[i : i + 40] = b"\1" * 40
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(text), sum(gone), hashlib.sha256(kept).hexdigest())


def test_targets_and_mix(docs):
    assert mixing.targets([10, 100, 100], (3, 1, 2), 210) == [20, pytest.approx(190 / 3), pytest.approx(380 / 3)]
    one, two = (sorted(map(str, mixing.mix(docs, (3, 1, 2)).collect())) for _ in range(2))
    assert one == two
    for r in mixing.mix(docs, (3, 1, 2)).collect():
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", next(b or "" for a, b in ROWS if a == r["id"])))


def test_probabilities_sum_to_one(docs):
    import numpy as np

    from graphloom.llm.common import hash_of

    m = lm_scoring.train(docs, shards=4)
    words = sorted({w.lower() for _, b in ROWS for w in (b or "").split()})
    vocabulary = np.array([*[hash_of(w) for w in words], lm_scoring.END, hash_of("never-seen")], np.uint64)
    for context in (lm_scoring.BEGIN, hash_of("w3"), hash_of("zz"), hash_of("never-seen")):
        _, p = lm_scoring.token_scores(m, np.full(len(vocabulary), context), vocabulary)
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_encoding_is_lossless_and_repeatable(docs):
    got = sentencepiece_codec.encode(docs).collect()
    assert all(r["lossless"] for r in got) and sorted(map(str, got)) == sorted(map(str, sentencepiece_codec.encode(docs).collect()))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()
    assert sorted((r["id"] or 0, r["text"]) for r in back) == sorted((a or 0, b or "") for a, b in ROWS)


def test_each_occurrence_of_a_word_is_segmented_anew():
    import random

    import numpy as np

    from graphloom.llm.common import mix

    v, r = sentencepiece_codec.Vocabulary(), random.Random(4)
    e = sentencepiece_codec.Encoder(v, 0.1, 5)
    word, n = " international", 2000
    ways = {tuple(x.tolist()) for x in e.encode_many(list(range(0, 1000 * n, 1000)), [word[1:]] * n)}
    assert len(ways) > 8 and tuple(sentencepiece_codec.segment(v, word, 0.0, 0)) in ways

    words = ["the", "understanding", "日本語", "naïve", "x\ny", "▁", "", "0123456789" * 4, "wonderful" * 5, "a"]
    texts = ["", *(" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(60))]
    keys = [r.getrandbits(63) for _ in texts]
    for again in range(2):  # the second time from what is kept
        for key, text, got in zip(keys, texts, e.encode_many(keys, texts), strict=True):
            parts = sentencepiece_codec._PART.findall(" " + text) if text else []
            own = mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(key)).tolist()
            assert got.tolist() == [x for part, k in zip(parts, own, strict=True) for x in sentencepiece_codec.segment(v, part, 0.1, k)]
            assert e.decode(got) == text.encode() if text else not len(got)


def test_search_equals_all_pairs(spark):
    import random

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(120)] + [(i, [1.0] * 64) for i in range(120, 160)] + [(160, None), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    code = {i: [x > 0 for x in v] for i, v in rows if i is not None and v}
    got = {}
    for x in topk_search.search(df, F.col("vec_id") % 50 == 0, k=5, block=64).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["distance"], x["neighbor_id"]))
    for q in (0, 50, 100, 150):
        want = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:5]
        assert [(d, n) for _, d, n in sorted(got[q])] == want


def test_topk_takes_all_elements(spark):
    import random

    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(100 if i % 3 else 97)]) for i in range(151)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, c0 int")
    code = {i: [x > 0 for x in v] + [False] * (100 - len(v)) for i, v in rows}
    got = {}
    for x in topk_search.search(df, F.col("vec_id") % 50 == 0, k=7, block=64).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["distance"], x["neighbor_id"]))
    assert sorted(got) == [0, 50, 100, 150]
    for q, found in got.items():
        assert [(d, n) for _, d, n in sorted(found)] == sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:7]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/1", "https://x.org", "https://x.org/", "http://example.org/en/12?q", "https://b.com/fr/1#x", "https://b.com/de/", None, "no scheme", "http://badorg/"]
    got = {r["id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["example.org/es/", None, "org/", "example.org/en/1", "com/fr/", "com/de/", None, None, None]
    assert got[0]["host"] == "a.example.org" and got[3]["path"] == "/en/12" and got[6]["host"] == "" and all(got[i]["verdict"] in ("allow", "block") for i in range(9))


def _tree(keys, fanout, z, prior):
    """The template tree with dictionaries: keys maps (host, segments) to (n, good, bad)."""
    total = lambda rows: [sum(x) for x in zip(*rows, strict=True)]
    at, done = {k: () for k in keys}, {}
    while True:
        done |= {k: t for k, t in at.items() if len(k[1]) <= len(t)}
        at = {k: t for k, t in at.items() if k not in done}
        if not at:
            break
        branches, nxt = {}, {}
        for k, t in at.items():
            branches.setdefault((k[0], t), {}).setdefault(k[1][len(t)], []).append(k)
        for (_, t), children in branches.items():
            n, g, b = total([keys[k] for ks in children.values() for k in ks])
            rate = (g + 1) / (g + b + 2)
            for piece, ks in children.items():
                cn, cg, cb = total([keys[k] for k in ks])
                off = abs(cg - (cg + cb) * rate) / (max(cg + cb, 1) * rate * (1 - rate)) ** 0.5
                star = len(children) > fanout and cn * len(children) < 2 * n or len(children) > 1 and cg + cb and off < z
                for k in ks:
                    nxt[k] = t + k[1][len(t) :] if sum(map(len, children.values())) == 1 else (*t, "*" if star else piece)
        at = nxt
    count = lambda f: total([[0, 0, 0], *(v for k, v in keys.items() if f(k))])[1:]
    g, b = count(lambda k: True)
    root, out = (g + 1) / (g + b + 1), {}
    for key, t in done.items():
        p = h = root
        for d in range(len(t) + 1):
            under = lambda k: done[k][:d] == t[:d] and len(done[k]) >= d  # noqa: B023, E731
            (pg, pb), (hg, hb) = count(under), count(lambda k: k[0] == key[0] and under(k))  # noqa: B023
            before, p = p, (pg + prior * p) / (pg + pb + prior) if d else root
            h = (hg + prior * (min(0.999, max(0.001, p + h - before)) if d else root)) / (hg + hb + prior)
        out[key] = "/" + "/".join(t), h
    return out


def test_template_tree_equals_dictionaries(spark):
    import random

    r, keys = random.Random(8), {}
    for host in ("a.com", "b.com", "c.net", "d.net"):
        for _ in range(90):
            segments = tuple(r.choice([f"s{r.randint(0, 30)}", "x", "{n}", "y"]) for _ in range(r.choice([0, 1, 1, 2, 3, 9])))
            bad = 6 if segments[:1] == ("y",) else r.randint(0, 1)
            labels = (r.randint(0, 4), bad) if host.endswith("com") else (0, 0)
            keys[host, segments] = (sum(labels) + r.randint(1, 3), *labels)
    df = spark.createDataFrame([(h, list(s), *v) for (h, s), v in keys.items()], "host string, segments array<string>, n long, good long, bad long")
    got = {(x["host"], tuple(x["segments"])): (x["template"], x["purity"]) for x in url_filter.templates(df).collect()}
    want = _tree(keys, url_filter.FANOUT, url_filter.Z, url_filter.PRIOR)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})
    assert len({v[1] for k, v in got.items() if k[0] == "c.net"}) > 5 and any("*" in v[0] for v in got.values())
    assert url_filter.templates(df.limit(0)).count() == 0


def test_extraction_on_generated_pages_and_odd_input(spark):
    import random

    model, r, right, total = html_extract.trained(), random.Random(77), 0, 0
    for _ in range(60):
        page, labels = html_extract.training_page(r)
        p = html_extract.probabilities(model, [html_extract.vectors(html_extract.blocks(page))])[0] > 0.5
        right, total = right + sum(a == b for a, b in zip(p, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    odd = [(1, None), (2, ""), (3, "<article><p>A &amp; b<br>c  d<p>e</article>"), (4, "<script>x"), (5, "plain")]
    got = {x["id"]: x["text"] for x in html_extract.extract(spark.createDataFrame([(a, "u", b) for a, b in odd], "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == got[4] == "" and got[3] == "A & b c d\ne"




def test_blocks_are_judged_whole_and_broken_markup_is_read():
    model = html_extract.trained()
    head, tail = "Accept all cookies. " * 30, "Read more about the harbour and the market, where the letter was found. " * 40
    a, b = (html_extract.vectors([(0, t, 0.0)])[0] for t in (head, head + tail))
    words = slice(html_extract.PATH_BITS, html_extract.PATH_BITS + html_extract.WORD_BITS)
    assert a[words].sum() == pytest.approx(1) and b[words].sum() == pytest.approx(1) and abs(a[words] - b[words]).sum() > 0.5
    page = "<article><p class=\"x>One.</p><p title='it's>Two words.</p><p>Three.</article>" + "<" * 2000
    assert html_extract.texts_of(model, [page])[0].split("\n")[:3] == ["One.", "Two words.", "Three."]
    long = html_extract.blocks("<main>" + "".join(f"<p>The harbour {i} and the market.</p>" for i in range(700)) + "</main><footer>Contact</footer>")
    assert html_extract.page_probabilities(model, long, 64) == pytest.approx(html_extract.probabilities(model, [html_extract.vectors(long)])[0], abs=1e-5)
    assert html_extract.texts_of(model, [""]) == [""] and html_extract.vectors([]).shape == (0, html_extract.INPUT)


def test_deep_pages_take_time_in_proportion():
    import time

    model = html_extract.trained()
    flat, deep = ("".join(f"{tag}a{i}" for i in range(20_000)) for tag in ("<hr>", "<div class=x>"))
    took = []
    for page in (flat, deep, deep + "</div>" * 20_000, "<p>" * 9 + "</b></i></div>" * 20_000, "<a" * 200_000, "<!" * 200_000, "> <a " * 3 + "<a" * 100_000):
        began = time.time()
        html_extract.texts_of(model, [page])
        took.append(time.time() - began)
    assert max(took) < 4 * took[0] + 5
    big = "<div>a" * 170_000
    found = html_extract.blocks(big)
    assert len(found) == 170_000 and found[-1][0] == found[5][0]
    kept = html_extract.blocks("<div id=a><p>x<span>y</span></div>z<!-- <p>no")
    assert [t for _, t, _ in kept] == ["xy", "z"] and kept[1][0] == 0 and kept[0][0]


def test_other_layouts_than_the_training_pages():
    model = html_extract.trained()
    prose = ["The council met on Monday to hear the plan for the new bridge.", "Nobody had expected so many people, and the hall was full.", "A vote will follow in spring."]
    inner = "".join(f"<p>{x}</p>" for x in prose)
    menu = "<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/c>Contact</a></ul>"
    layouts = [
        f"<body><nav>{menu}</nav><main><section>{inner}</section></main><footer>&copy; Gazette</footer></body>",
        f"<html><body><div id=top class='header menu'>{menu}</div><div class='content'><div class='text'>{inner}</div></div><div class='sidebar'><h3>Popular</h3>{menu}</div></body></html>",
        f"<article>{inner}</article><div class='comments'><h3>Comments</h3><p>Great read, thanks!</p><p>I disagree.</p></div><form><label>Search</label></form>",
    ]
    assert html_extract.texts_of(model, layouts) == ["\n".join(prose)] * 3


def test_segments_equal_the_library_and_each_other():
    import random

    import numpy as np
    import sentencepiece

    v, r = sentencepiece_codec.Vocabulary(), random.Random(9)
    m, sp = sentencepiece_codec.Merges(v), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    words = ["harbour", "internationalisation", "the", "of", "x1y2", "Überraschung", "señor", "don't", "日本", "a", "zzzz"]
    plain = sentencepiece_codec.Encoder(v, 0.0, 0)
    for _ in range(80):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 30)))
        assert plain.encode(0, text).tolist() == sp.encode(text)
    parts = [" " + "".join(r.choice("abcdeinrst ñ日") for _ in range(r.randint(1, 20))).replace(" ", "") for _ in range(400)]
    keys = np.array([r.getrandbits(63) for _ in parts], np.uint64)
    for dropout in (0.0, 0.1, 0.6):
        got = sentencepiece_codec.segment_many(v, m, parts, keys, dropout)
        assert [np.frombuffer(x, np.int32).tolist() for x in got] == [sentencepiece_codec.segment(v, p, dropout, int(k)) for p, k in zip(parts, keys, strict=True)]
    long = "".join(r.choice(words) + r.choice(["", "qx", "日"]) for _ in range(900))
    assert len(plain.cut(long)) > 50 and plain.encode(0, long).tolist() == sentencepiece_codec.segment(v, " " + long, 0.0, 0)
    assert plain.decode(plain.encode(0, long)) == long.encode()
