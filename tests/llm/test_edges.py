"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import numpy as np
import pytest

from review_insights.llm import (common, group_join, langid, line_quality, lpf_dedup, mixing, packing, radix_dedup, token_counts,
                                 toxicity, wrapper_induction)
from tests.llm import brute

random.seed(3)
WORDS = [f"w{k}" for k in range(400)]
LONG = " ".join(random.choice(WORDS) for _ in range(30_000))
BASE = " ".join(random.choice(WORDS) for _ in range(120))
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (5, BASE), (3, BASE), (3, BASE), (9, NEAR), (None, NEAR), (10, None), (11, ""), (12, " "), (13, "\n\t "), (14, " \x0b"),
    (15, "one two"), (16, "ONE  two"), (17, "one two"), (18, LONG), (19, LONG + " end"), (20, "Grüße, ÉTÉ <|endoftext|> 中文 it's"),
    (21, BASE + " " + BASE), (22, "x" * 450), (23, "x" * 99), (24, " lead" + BASE), (25, BASE + "\n"), (None, "tail"),
]
CLASHES = {"id": "string", "data": "binary", "row": "long", "score": "double", "kept": "boolean", "n": "int", "_mix_p": "double", "_radix_row": "long", "_join_row": "string"}


def frame(spark, rows, parts=3):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{k}` {v}" for k, v in CLASHES.items())
    full = [(i, t, ["en", None, "de"][k % 3], ["src0", None, "zz"][k % 3], *[None] * len(CLASHES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "docs")
    frame(spark, ROWS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    """Rows in the order in which they are read."""
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], 1)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_exact_groups(docs, rows):
    found = radix_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    same(found, brute.exact_groups(rows))


def test_radix_recursion_on_shared_prefixes():
    texts = [b"a" * 600 + bytes([k % 3]) * (k % 5) for k in range(40)] + [b"", b"", b"a" * 64, b"a" * 64 + b"b"]
    groups = radix_dedup.radix_groups(texts)
    assert sorted(sorted(g) for g in groups) == sorted(
        [k for k, u in enumerate(texts) if u == t] for t in set(texts))


def test_drop_exact_copies(docs):
    left = radix_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [brute.normalised(r["text"]) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({brute.normalised(t) for _, t in ROWS})


@pytest.mark.parametrize("size, num", [(4, 85), (5, 80), (1, 50)])
def test_near_components(docs, rows, size, num):
    found = group_join.near_duplicate_components(docs, size=size, num=num).select("doc_id", "n_shingles", "component_id").collect()
    same(found, [r[:3] for r in brute.near_components(rows, size, num, 100)])


def test_near_components_with_tiny_bounds(spark, monkeypatch):
    """Heavy shingles, many blocks and look-ups by shuffle give the same components."""
    for name, value in (("HEAVY", 5), ("BLOCK", 2), ("SMALL", 2), ("COUNT_AT", 50), ("HUBS", 1)):
        monkeypatch.setattr(group_join, name, value)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for k in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"e{rng.randint(0, 50)}"
        rows.append((k, " ".join(text)))
    docs = frame(spark, rows, 4)
    found = group_join.near_duplicate_components(docs, size=3, num=75).select("doc_id", "n_shingles", "component_id").collect()
    same(found, [r[:3] for r in brute.near_components(rows, 3, 75, 100)])


def test_drop_near_copies(docs, rows):
    left = group_join.drop_near_copies(docs, size=4, num=85)
    assert left.columns == docs.columns
    wanted = [r[0] for r in brute.near_components(rows, 4, 85, 100) if r[3] or r[1] == 0]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted((i is None, i or 0) for i in wanted)


def test_remove_repeats(docs, rows):
    same(lpf_dedup.remove_repeats(docs).collect(), brute.repeats(rows))


def test_remove_repeats_hot_anchors_and_tiles(docs, rows, monkeypatch):
    monkeypatch.setattr(lpf_dedup, "LOCAL_HOT", 1)
    monkeypatch.setattr(lpf_dedup, "TILE", 3_000)
    monkeypatch.setattr(lpf_dedup, "UNIT_BYTES", 2_000)
    same(lpf_dedup.remove_repeats(docs, hot_at=2).collect(), brute.repeats(rows))


def test_anchors_are_counted_over_all_units(monkeypatch):
    """A line found a few times in every unit, in ever new surroundings, counts in full."""
    import pyarrow as pa

    monkeypatch.setattr(lpf_dedup, "UNIT_BYTES", 1_000)
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh") for _ in range(150))
    texts = ["".join(rng.choice("ijklmnop") for _ in range(150)) + line for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["id", "data"])
    total = {}
    for found in lpf_dedup._count_anchors(iter([batch])):
        for anchor, count in zip(*(c.to_pylist() for c in found.columns)):
            total[anchor] = total.get(anchor, 0) + count
    assert sum(n >= 60 for n in total.values()) >= 1
    assert min(total.values()) == 1


def test_token_counts(docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    wanted = []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        wanted.append((i, len((text or "").encode()), n, n > 2048))
    same(token_counts.count_tokens(docs).collect(), wanted)


def test_pre_tokens_equal_the_library_on_odd_characters():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, split = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_counts.PreTokens(None)
    rng = random.Random(1)
    texts = ["İstanbul ΑΣ ² ½ x​y é é 12３4", "<|startoftext|>a<|endoftext|>", "'s's''ss 'LL", "ﬁ ǅ ẞ a　b"]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(1, 0xD7FF), 32, 39])) for _ in range(40)) for _ in range(200)]
    for text in texts:
        words, base = split.split(text)
        assert base + sum(split.pieces(words)) == len(t.encode(text, add_special_tokens=False).ids), text


def test_pre_tokens_are_normalised_once():
    """Lower-casing U+0130 makes a mark that a second normalisation would move behind others."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, split = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_counts.PreTokens(None)
    rng = random.Random(7)
    marks = [chr(c) for c in (0x300, 0x307, 0x316, 0x31c, 0x323, 0x327, 0x338, 0x345, 0x5b0, 0x64b, 0x93c, 0x1dc0)]
    texts = ["\u0130\u031c", "\u0130\u0338", "x\u0130\u0338\u0307y"]
    texts += ["".join(rng.choice(["\u0130", "I", "i", "a", " ", "\u1e9e", *marks]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for text in texts:
        words, base = split.split(text)
        assert base + sum(split.pieces(words)) == len(t.encode(text, add_special_tokens=False).ids), ascii(text)


def test_pre_tokens_equal_the_library_on_ascii():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, split = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_counts.PreTokens(None)
    rng = random.Random(2)
    texts = [f"{a}{chr(c)}{b}" for c in range(128) for a, b in (("a", "b"), ("x ", " y"), ("1", "'s"))]
    texts += ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(33), 32, 39])) for _ in range(40)) for _ in range(300)]
    for text in texts:
        words, base = split.split(text)
        assert base + sum(split.pieces(words)) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_packing(docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs).collect()
    padding, total = brute.check_pieces(pieces, rows, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert padding == 0 and total > 0


def test_sum_of_squares_choice():
    packer = packing.SumOfSquaresPacker(10)
    assert packer.place("a", 0, 25) == [[("a", 0, 10)], [("a", 10, 10)]]  # the rest opens a window at level 5
    assert packer.count[5] == 1
    assert packer.place("b", 0, 5) == [[("a", 20, 5), ("b", 0, 5)]]
    rng = np.random.default_rng(4)
    for size in rng.integers(1, 10, 300):
        here = packer.count.copy()
        best = None
        for level in range(0, 10 - size + 1):
            if level and not here[level]:
                continue
            after = here.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            cost = int((after[1:10] ** 2).sum())
            best = min(best, (cost, -level)) if best else (cost, -level)
        assert packer.level_for(int(size)) == -best[1]
        packer.place("c", 0, int(size))
    closed = packer.close()
    fills = [sum(p[2] for p in w) for w in closed]
    assert all(f == 10 or f & (f - 1) == 0 for f in fills)


def test_line_quality(docs, rows):
    found = line_quality.line_quality(docs).select("doc_id", "n_words", "word_chars", "n_repeat_words", "base_failed").collect()
    wanted = []
    for i, text in rows:
        words = (text or "").encode().split()
        seen = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        many = {w for w in set(seen) if len(words) < 3000 and seen.count(w) > 1}
        if len(words) >= 3000:
            from collections import Counter
            many = {w for w, c in Counter(seen).items() if c > 1}
        covered = {k + s for k, w in enumerate(seen) if w in many for s in range(3)}
        wanted.append((i, len(words), sum(len(w.decode()) for w in words), len(covered),
                       len(words) < 50 or 100 * len(covered) > 50 * len(words)))
    same(found, wanted)


@pytest.mark.parametrize("line, fails", [
    ("A sentence of prose that ends as it should.", False), ("Home", True), ("Home | About | News | Contact us now here", True),
    ("Licensed under the Apache License, Version 2.0.", True), ("THIS LINE SHOUTS AT EVERYBODY WHO READS IT!", True),
    ("word### other$$$ more%%% text&&& here", True), ("A longer line of prose without any closing mark at all", False),
])
def test_line_rules(line, fails):
    assert line_quality.line_fails(line, len(line.split())) is fails


def test_clean_documents(spark):
    docs = spark.createDataFrame([(1, "Home\nA sentence that stays.\n\nMenu")], "doc_id long, text string")
    assert [r["text"] for r in line_quality.clean_documents(docs).collect()] == ["A sentence that stays.\n"]


def test_language_id(docs, spark):
    model = langid.fit(["the cat and the dog " * 5] * 20 + ["der hund und die katze " * 5] * 20, ["en"] * 20 + ["de"] * 20)
    found = {r["doc_id"]: r for r in langid.predict_languages(docs, model).collect() if r["doc_id"] is not None}
    assert found[10]["lang_pred"] == found[11]["lang_pred"] == found[13]["lang_pred"] == "und" and found[10]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.predict(model.parts(), "the dog")[0] == "en" and langid.predict(model.parts(), "die katze")[0] == "de"
    assert langid.predict(langid.fit([], []).parts(), "text")[0] == "und"


def test_toxicity_scores(docs):
    model = toxicity.fit(["you idiot go away", "nice day today", "what an idiot", "lovely day"] * 10, [1, 0, 1, 0] * 10)
    found = toxicity.score_documents(docs, model).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 for r in found)
    assert model.score("such an idiot") >= 0.7 > model.score("such a day")
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert toxicity.fit(["a"], [1]).score("a") < 0.7


def test_mixing(docs):
    found = mixing.mix(docs).collect()
    assert len(found) == len(ROWS) and all(0 <= r["probability"] <= 1 for r in found)
    assert {r["source"] for r in found} <= set(mixing.SOURCE_TARGETS) and {r["lang"] for r in found} <= set(mixing.LANG_TARGETS)
    assert mixing.mix(docs, carry=True).columns == docs.columns


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(2)
    axes = [np.repeat(np.arange(3), 8), np.tile(np.repeat(np.arange(2), 4), 3), np.tile(np.arange(4), 6)]
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.1, 0.2, 0.3, 0.4])]
    w = mixing.rake(rng.integers(1, 100, 24).astype(float), axes, targets, 60)
    for axis, target in zip(axes, targets):
        assert np.allclose(np.bincount(axis, w), target)
    tokens, rate = rng.integers(1, 100, 24).astype(float), rng.random(24) * 3
    scale = mixing.solve_scale(tokens, rate, 0.6 * tokens.sum())
    assert np.isclose((tokens * np.minimum(1, scale * rate)).sum(), 0.6 * tokens.sum())


PAGE = ('<html><body><header class=site>Site</header><div id=nav><ul><li><a href=x>A</a></ul></div><div class="post"><h1>T%d</h1>'
        '<p>Hello %d &amp; more <b>bold</b><br>text<p>Follow us</p><script>var a="<p>x</p>"</script><ul><li>item %d<li>%d two</ul>'
        '<div class="comments"><p>c</p></div></div><div class="sidebar">s</div></body></html>')


def test_wrapper_induction(spark):
    pages = [(k, f"http://h.example/{k}", PAGE % (k, k, k, k)) for k in range(12)]
    pages += [(20, None, None), (21, "http://z.example/", ""), (22, "not a url", "plain &lt; text"), (22, "not a url", "plain &lt; text"),
              (None, "http://z.example/", "<article><p>a <i>b<p>c</article><footer>f</footer>")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, wrapper string").repartition(3)
    found = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in wrapper_induction.extract_text(df).collect()), key=key)
    wanted = [(k, f"T{k}\nHello {k} & more bold text\nitem {k}\n{k} two") for k in range(12)]
    wanted += [(20, ""), (21, ""), (22, "plain < text"), (22, "plain < text"), (None, "a b\nc")]
    assert found == sorted(((i, t, len(t)) for i, t in wanted), key=key)


def test_simple_tree_matching():
    tree = lambda s: wrapper_induction.runs_of([wrapper_induction.parse(s)])
    a, b = tree("<div><h1>x</h1><p>y</p></div>"), tree("<div><p>y</p></div>")
    assert wrapper_induction.match(a, a)[0] == 5 and wrapper_induction.match(a, b)[0] == 3


def test_empty_tables(empty, spark):
    for run in (radix_dedup.exact_groups, group_join.near_duplicate_components, lpf_dedup.remove_repeats, token_counts.count_tokens,
                packing.pack, line_quality.line_quality, mixing.mix):
        assert run(empty).count() == 0, run
    assert radix_dedup.drop_exact_copies(empty).count() == group_join.drop_near_copies(empty).count() == 0
    assert langid.predict_languages(empty, langid.fit([], [])).count() == 0
    assert toxicity.score_documents(empty, toxicity.fit([], [])).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrapper_induction.extract_text(pages).count() == 0


@pytest.mark.parametrize("blocks", [5, 9, 20])
def test_wrapper_induction_counts_every_recurring_text(spark, blocks):
    """One notice beside many varying blocks, and a constant block of many lines."""
    html = lambda k: ("<body><article><p>Read our terms.</p>" + "".join(f"<p>page {k} part {j}</p>" for j in range(blocks)) + "</article>"  # noqa: E731
                      "<ul>" + "".join(f"<li>fixed line {j}</li>" for j in range(blocks)) + "</ul></body>")
    df = spark.createDataFrame([(k, f"http://h.example/{k}", html(k)) for k in range(200)], "page_id long, url string, html string")
    for r in wrapper_induction.extract_text(df.repartition(3)).collect():
        assert r["text"] == "\n".join(f"page {r['page_id']} part {j}" for j in range(blocks))


@pytest.mark.parametrize("opening, closing", [
    ('<div class="content has-sidebar">', "</div>"), ('<div id="main" class="no-sidebar">', "</div>"),
    ('<section class="widget"><div id="search-result">', "</div></section>"), ('<div><span class="notice">', "</span></div>")])
def test_wrapper_induction_keeps_named_sections_with_the_text(spark, opening, closing):
    """Names decide for sections of little text only, on hosts of many pages and of one; an empty page stays empty."""
    para = "</p><p>".join if "span" not in opening else " ".join
    html = lambda k, parts: (f'<body><div id="nav">menu {k}</div>{opening}' + (f"<p>{para(parts)}</p>" if "span" not in opening else para(parts))
                             + f'{closing}<div class="sidebar">sidebar {k}</div><div class="ad">ad {k}</div></body>')
    parts = {k: [f"text {k} has part {j} of more words" for j in range(6)] for k in range(30)}
    rows = [(k, f"http://{'one' if k == 29 else 'h'}.example/{k}", html(k, parts[k] if k != 28 else [])) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sep = "\n" if "span" not in opening else " "
    wanted = {k: sep.join(parts[k]) if k != 28 else "" for k in range(30)}
    assert {r["page_id"]: r["text"] for r in wrapper_induction.extract_text(df.repartition(3)).collect()} == wanted


def test_names_mark_sections_of_little_text():
    page = wrapper_induction.parse('<div id="nav">menu</div><div><p>Long text of the page <span class="share">share it</span></p>'
                                   '<div class="comments"><p>a comment</p></div></div>')
    assert wrapper_induction.extract(page, None) == "Long text of the page"


def test_bitmaps_of_several_sizes_bound_the_difference():
    """Folded onto the smaller size, they differ in no more bits than the sets in elements."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 900, 1024, 1025, 1100, 5000, 5100)]
    sets += [np.sort(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 10 + 1).astype(np.uint64)])) for s in sets]
    maps = group_join.Bitmaps(np.array([group_join.bitmap(s) for s in sets], object))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    found = maps.different(a, b)
    for x, y, d in zip(a, b, found):
        assert d <= len(np.setxor1d(sets[x], sets[y]))
    assert all(d == 0 for x, y, d in zip(a, b, found) if x == y)
    wide = (len(sets[6]) + len(sets[7]) - found[(a == 6) & (b == 7)][0]) // 2
    assert wide < 0.7 * 5000  # sets of 5,000 without a common element are told apart
