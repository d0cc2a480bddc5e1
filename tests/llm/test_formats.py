"""WARC archives, token files, HTML extraction, chat formatting, packing, and the pipeline."""

import gzip
import hashlib
import html
import io
import random
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegrove.llm import chat_events, line_blocks, packing, token_store, warc
from pagegrove.llm.common import open_store, shared_path
from pagegrove.llm.queries import tokenizer_path

PAGES = "page_id long, url string, html string, extra string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], PAGES)


# ---- WARC ----------------------------------------------------------------

def test_archives_round_trip(spark):
    long, copy = "é<p>" * 60_000, "same " * 40
    rows = [(5, "http://a/ b\r\nX: y", copy), (3, None, copy), (9, "u", copy), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
            (7, "u", long), (None, "u", copy), (8, "u", "WARC/1.1\r\n\r\n" * 20), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "x" * 100), (13, "u", "x" * 100)]
    got = {r.page_id: r for r in warc.archive(pages(spark, rows), roll=50_000).collect()}
    assert len(got) == len(rows)
    for i, _url, text in rows:
        raw = (text or "").encode()
        r = got[i]
        same = [j for j, _, t in rows if (t or "") == (text or "") and j is not None]
        first = min(same) if len(raw) >= 100 else i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.payload == (raw if i == first else None)
    assert "\n" not in got[5].uri
    assert warc.archive(pages(spark, [])).count() == 0
    twice = warc.archive(pages(spark, [(1, "u", copy), (1, "u", copy), (2, "u", copy)])).collect()
    assert sorted((r.page_id, r.record_type) for r in twice) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_normalised_members_stand_alone(spark):
    raw, target = shared_path(spark, "raw"), shared_path(spark, "norm")
    files = warc.write_archives(pages(spark, [(i, "u", f"page {i} " * 50) for i in range(40)]), raw, roll=4000)
    fs, root = open_store(raw)
    for r in files.collect():
        data = Path(f"{root}/{r.file}").read_bytes()
        d = zlib.decompressobj(31)
        d.decompress(data)
        assert d.eof and not d.unused_data  # one member for the whole file
    normal = warc.normalise(files, raw, target)
    _, root = open_store(target)
    n = 0
    for r in normal.collect():
        data = Path(f"{root}/{r.file}").read_bytes()
        for line in Path(f"{root}/{r.file}.idx").read_text().splitlines():
            import json
            x = json.loads(line)
            assert warc.read_member(data[x["offset"]:x["offset"] + x["length"]])[1] == x["type"]
            n += 1
    assert n == 40 and files.count() > 1


def test_inflated_reads_members_padding_and_reports_cuts():
    rec = warc.record(1, "u", b"abc" * 1000, "d", None) + warc.record(2, "u", b"", "d", None)
    for data in (gzip.compress(rec), gzip.compress(rec[:50]) + gzip.compress(rec[50:]) + b"\0" * 10):
        x, seen = warc.Inflated(io.BytesIO(data)), []
        while head := x.head():
            seen.append(b"".join(x.blocks(int(warc.fields(head)["content-length"]))))
        assert len(seen) == 2 and seen[0].endswith(b"abc")
    x = warc.Inflated(io.BytesIO(gzip.compress(rec)[:-20]))
    with pytest.raises(EOFError):
        while head := x.head():
            list(x.blocks(int(warc.fields(head)["content-length"])))
    assert warc.Inflated(io.BytesIO(b"")).head() == b""


# ---- tokens --------------------------------------------------------------

def test_token_files(spark, docs_of, prose):
    from tokenizers import Tokenizer
    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    r = random.Random(2)
    rows = [(r.randrange(-50, 1000), prose(i, r.choice([1, 5, 80, 400]))) for i in range(120)] + [(2000, "word " * 40_000), (2001, ""), (2002, None), (None, "null id"), (2003, "İ é ﬁ x")]
    rows += [(2001, ""), (2001, "again")]
    folder = shared_path(spark, "tok")
    files = token_store.write_store(docs_of(rows, extra=True), folder, path, files=5)
    got = sorted(token_store.read_store(files, folder).collect(), key=lambda x: x.start)
    ids = [x.doc_id for x in got]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0)) and files.count() > 1
    at, left = 0, [(i, x) for i, x in rows]
    for x in got:
        assert x.start == at
        own = [k for k, (i, text) in enumerate(left) if i == x.doc_id and x.ids_crc32 == crc(t, text)]
        assert own, x
        text = left.pop(own[0])[1]
        assert x.n_tokens == len(t.encode(text or "", add_special_tokens=False).ids) + 1
        at += x.n_tokens
    assert not left
    assert token_store.token_table(docs_of([]), path).count() == 0


def crc(t, text):
    ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_single_document_access(spark, docs_of, prose):
    folder = shared_path(spark, "tok")
    files = token_store.write_store(docs_of([(i, prose(i, 60)) for i in range(200)]), folder, tokenizer_path(), files=1)
    fs, root = open_store(folder)
    with fs.open_input_file(f"{root}/{files.first().file}") as src:
        index, reader = token_store.read_index(src), token_store.open_reader(fs, root, src)
        e = index[77]
        ids = reader.decompress(src.read_at(int(e["length"]), int(e["offset"])))
        assert e["id"] == 77 and ids == token_store.Encoder(tokenizer_path()).encode(prose(77, 60))
        assert int(index["length"].sum()) < 0.9 * 4 * int(index["tokens"].sum())
    (Path(root) / "dictionary").write_bytes(b"other")
    with fs.open_input_file(f"{root}/{files.first().file}") as src, pytest.raises(ValueError):
        token_store.open_reader(fs, root, src)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aB's \n\t\x1c\x851<|>.,*", "é", "\u0301", "İ", "Σ", "漢", "😀", "É", "<|endoftext|>", "don't", "\r\n", "Word.", "é!!"]), max_size=40).map("".join))
def test_words_give_the_ids_of_the_whole_text(text):
    global _ENCODER
    if "_ENCODER" not in globals():
        from tokenizers import Tokenizer
        _ENCODER = (Tokenizer.from_file(tokenizer_path()), token_store.Encoder(tokenizer_path(), None))
    whole = np.array(_ENCODER[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert _ENCODER[1].encode(text) == whole


def test_a_word_is_looked_up_once_for_many_texts():
    class Counted(token_store._Parts):
        asked = 0

        def __getitem__(self, part):
            self.asked += 1
            return super().__getitem__(part)
    encoder = token_store.Encoder(tokenizer_path())
    encoder.parts = Counted(encoder)
    texts = ["Größe und Größe", None, "", "\n und  Größe\n", " ", "größe. 漢 \x1c İ"] * 50
    ids, start = encoder.encode_many(pa.array(["left out", *texts]).slice(1))
    assert encoder.parts.asked <= 2 * len({"Größe", "und", "größe.", ""})
    assert start[0] == 0 and len(start) == len(texts) + 1 and start[-1] == len(ids)
    for text, a, z in zip(texts, start[:-1], start[1:], strict=True):
        assert ids[a:z].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


# ---- HTML ----------------------------------------------------------------

HTML = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy this now please</div>"
     "<article><h1>Ti &amp; tle</h1><p>One <b>two</b>\n three<br>four<p>Hi.</p><aside>Side</aside><form>Name <input></form><script>var a='</p>'</script>"
     "<section id=comments><p>Nice post!</p></section><p>&copy; End</article><footer>Foot</footer>", "Ti & tle\nOne two three four\nHi.\n© End"),
    ("<body><div id=menu><a>a</a></div><div><p>" + "First long paragraph of the story. " * 5 + "</p><p>Short.</p><p>" + "Last long paragraph of the story. " * 5 + "</p></div>"
     "<div class='cookie-notice'>We use cookies</div></body>", ("First long paragraph of the story. " * 5).strip() + "\nShort.\n" + ("Last long paragraph of the story. " * 5).strip()),
    ("<main><h2>Head</h2><ul><li>a<li>b</ul></main><p>Outside</p>", "Head\na\nb"),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<!-- only -->", ""), ("<article>a &lt;b&gt; &#8364; &quo x", "a <b> € &quo x"),
    ("<article><p>a</p><article><p>in</p></article><p>z</p></article><article class=comment><p>me</p></article>", "a\nin\nz"),
]


def test_a_word_is_spelt_once_for_all_its_cases_and_marks():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)
    encoder = token_store.Encoder(tokenizer_path(), None)
    encoder.parts.clear()
    encoder.letters = Counted(encoder.letters)
    words = ["größe", "Größe.", "GRÖSSE", "GRÖßE,", "Größe!!", "größe;", "crème", "CRÈME", "Crème."]
    assert [encoder.encode(w) for w in words] == encoder._whole(words)
    assert encoder.letters.asked <= len("grösse") + len("größe") + len("crème") + len(".,!!;")


def test_extraction(spark):
    rows = [(i, "u", h) for i, (h, _) in enumerate(HTML)] * 2
    out = line_blocks.extract(pages(spark, rows).withColumnRenamed("extra", "text")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == HTML[r.page_id][1], r.page_id
    assert line_blocks.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("attrs", [
    'style="overflow:hidden"', 'data-hidden="false"', 'title="The hidden city"', "title='hidden'", 'data-id="menu-1"', "data-role=banner", 'itemid="http://x/comment/1"',
    'data-class="ad" class="story"', "data-x=a/hidden", 'title=" class=ad "', 'aria-hidden="false"', 'data-y=\'itemprop="articleBody"\''])
def test_only_whole_attribute_names_mark_boilerplate(attrs):
    for tag in ("article", "div"):
        assert line_blocks.main_text(f"<body><{tag} {attrs}><p>The story.</p></{tag}></body>") == "The story."
    assert line_blocks.main_text(f"<body><div {attrs}><article><p>The story.</p></article></div></body>") == "The story."


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN", "hidden=''", 'title="a b"hidden', "class=ad", "data-x=1 id='menu'", 'role = "Banner"', "aria-hidden=true", 'x="1"class="share-box"'])
def test_marked_elements_go(attrs):
    assert line_blocks.main_text(f"<body><p>The story.</p><div {attrs}><p>Not this</p></div></body>") == "The story."


LONG = "A long paragraph of the one story. " * 8
LINKS = "".join(f"<p><a href=x>link number {i}</a></p>" for i in range(4))


@pytest.mark.parametrize(("page", "want"), [
    (f"<main><p>{LONG}</p><article class=card>teaser</article></main>", [LONG, "teaser"]),
    (f"<main><p>{LONG}</p><p>b</p></main><article>teaser</article>", [LONG, "b", "teaser"]),
    (f"<article><p>{LONG}</p></article><p>Advert</p><article><p>Second part.</p></article><p>Outside</p>", [LONG, "Second part."]),
    (f"<div><p>{LONG}</p>{LINKS}<p>Second half.</p></div>", [LONG, "Second half."]),
    (f"<div><p>{LONG}</p></div>{LINKS}<article>teaser</article>", [LONG, "teaser"]),
    (f"<p>Outside</p><main><p>Before</p><article><p>{LONG}</p>{LINKS}<p>end</p></article></main>", [LONG, *(f"link number {i}" for i in range(4)), "end"]),
    ("<main></main><div><p>The story.</p></div>", ["The story."]),
    (f"<div itemprop=articleBody><p>{LONG}</p></div><p>Outside</p>", [LONG]),
])
def test_no_box_hides_the_rest_of_the_text(page, want):
    assert line_blocks.main_text(page) == "\n".join(x.strip() for x in want)


STORY = "<article><h1>Title</h1><p>The story is told here.</p></article>"


@pytest.mark.parametrize(("page", "want"), [
    (f'<div class="layout has-sidebar">{STORY}</div>', "Title\nThe story is told here."), (f'<div class="page no-sidebar">{STORY}</div>', "Title\nThe story is told here."),
    (f'<div id="post-header-and-body">{STORY}</div>', "Title\nThe story is told here."), (f'<div class="topic social science">{STORY}</div>', "Title\nThe story is told here."),
    ('<article><p>The story.</p><section class="related-work"><p>Others found the same.</p></section></article>', "The story.\nOthers found the same."),
    ('<header>Site</header><article><header><h1>Title</h1><p class="byline">By A. B.</p></header><p>It is <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p></article>', "Title\nBy A. B.\nIt is x=1 here."),
    (f'<div class="site-footer">Foot</div><div class="col-md-4 sidebar">Side</div><div id="cookie-banner-2">Cookies</div>{STORY}<div class="comment-list"><article>Mine</article></div>', "Title\nThe story is told here."),
    ('<div id="nav"><p>Nothing else is on this page.</p></div>', "Nothing else is on this page."),
    (f"<p>{LONG}</p>{LINKS}<p>x</p>", LONG.strip()),  # a lone line far below the largest window is no surge ...
    (f"<main><p>{LONG}</p>{LINKS}<p>x</p></main>", "\n".join([LONG.strip(), *(f"link number {i}" for i in range(4)), "x"])),  # ... but in a box it is text
    ('<article><p>One.</p><div class="ad">Buy</div><div class="ad">this</div><div class="ad">now</div><div class="ad">!</div><p>End.</p></article>', "One.\nEnd."),
])
def test_names_and_windows(page, want):
    assert line_blocks.main_text(f"<body>{page}</body>") == want


@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 5, 40, 900]), st.booleans()), max_size=40))
@settings(max_examples=300, deadline=None)
def test_surge_and_dive_equal_their_plain_definition(rows):
    n, box = [x for x, _ in rows], [b for _, b in rows]
    got = [i for a, b in line_blocks.stretches(n, box) for i in range(a, b + 1)]
    window = lambda i: sum(n[i:i + line_blocks.WINDOW])
    peak = max((window(i) for i in range(len(n))), default=0)
    surge = [n[i] > 0 and (box[i] or line_blocks.SHARE * window(i) >= peak) for i in range(len(n))]
    want = []
    for i in range(len(n)):  # a line is kept if a surge lies at it or before it and a counting line at it or after it, with no empty window between
        before = any(surge[a] and all(window(k) for k in range(a + 1, i + 1)) for a in range(i + 1))
        after = any(n[b] and all(window(k) for k in range(i + 1, b + 1)) for b in range(i, len(n)))
        if before and after:
            want.append(i)
    assert got == want


def test_windows_give_the_text_of_every_page(spark):
    from pagegrove.llm.common import table
    for r in table(spark, "/root/testdata/sf0.001", "pages").collect():
        lines = line_blocks.lines_of(r.html)
        n, box, out = line_blocks.counts(lines)
        (surge, dive), = line_blocks.stretches(n, box)  # one surge, one dive
        body = re.search(r"(?s)<article>(.*?)(</article>|$)", r.html)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert line_blocks.main_text(r.html) == "\n".join(x for x in want if x) and not any(out[surge:dive + 1])


def test_extraction_time_grows_with_the_page():
    import time
    page = lambda n: "<article>" + "<p>some words here <b>and there" * n
    t0 = time.perf_counter()
    assert line_blocks.main_text(page(20_000)).count("\n") == 19_999
    assert time.perf_counter() - t0 < 10
    assert line_blocks.main_text("<div>" * 50_000 + "deep") == "deep"


# ---- chat ----------------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<\\s>", "<<s>", "a\\\\b[INST", "", None, "é😀\n", "</s", "[[INST]]"]


def test_chat_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)] + [(2, 5, "system", "later"), (2, None, "user", "first"), (2, 5, "system", "later")]
    rows += [(None, 0, None, "x" * 50_000), (3, 1, "[INST]", "t"), (3, 1, "assistant", "u")]
    log = chat_events.events_of(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq long"), delta_chars=3)
    formatted = chat_events.format_events(log)
    got = {r.conv_id: r for r in formatted.collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((("" if r[1] is None else r[1]) != "", r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        turns = [(role, text) for _, _, role, text in turns]
        assert chat_events.parse(got[conv].formatted) == turns
        inside = [chat_events.unescape(got[conv].formatted[s.start:s.stop]) for s in got[conv].loss]
        assert inside == [t for r, t in turns if r == "assistant"]
    d = {r.conv_id: r for r in chat_events.digests(formatted).collect()}
    assert d[2].n_turns == 3 and d[2].loss_chars == 0 and d[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert d[2].turns_sha256 == hashlib.sha256(b"user\nfirst\nsystem\nlater\nsystem\nlater\n").hexdigest()
    assert d[1].formatted_chars == len(got[1].formatted)
    assert chat_events.digests(chat_events.format_events(log.limit(0))).count() == 0


def test_chat_roles_follow_the_last_opening(spark):
    e = [(1, 1, 0, 0, "start", "user", "a"), (1, 1, 0, 1, "delete", None, None), (1, 1, 0, 2, "start", "assistant", "b"),
         (1, 2, 1, 0, "start", "user", "c"), (1, 2, 1, 1, "edit", "bot", "d"), (1, 3, 2, 0, "delta", None, "e"), (1, 3, 2, 1, "delta", "tool", "f"),
         (1, 4, 3, 0, "start", "user", "g"), (1, 4, 3, 1, "delete", None, None), (1, 4, 3, 2, "delta", None, "h"), (1, 5, 4, 0, "start", "user", "i"), (1, 5, 4, 1, "start", "assistant", "j"),
         (1, 6, 5, 0, "delta", None, "k")]
    log = spark.createDataFrame(e, "conv_id long, msg long, turn long, seq long, kind string, role string, text string")
    got = [(r.role, r.text) for r in chat_events.fold(log).orderBy("turn").collect()]
    assert got == [("assistant", "b"), ("user", "d"), ("tool", "ef"), ("user", "h"), ("assistant", "j"), ("", "k")]
    formatted = chat_events.format_events(log).first()
    assert [chat_events.unescape(formatted.formatted[s.start:s.stop]) for s in formatted.loss] == ["b", "j"]


def test_chat_log_has_all_kinds_and_long_texts(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} " * (c % 5)) for c in range(20) for t in range(4)] + [(99, 0, "assistant", "very long " * 60_000), (99, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_events.events_of(turns)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"start", "delta", "edit", "regenerate", "delete"}
    got = sorted(tuple(r) for r in chat_events.fold(log).collect())
    assert got == sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    d = {r.conv_id: r for r in chat_events.digests(chat_events.format_events(log)).collect()}
    assert d[99].loss_chars == 600_000 and d[99].n_turns == 2


def test_chat_folds_deltas_edits_and_regenerations(spark):
    e = [(1, 1, 0, 0, "start", "user", "Hi"), (1, 1, 0, 1, "delta", None, " you"), (1, 2, 1, 2, "start", "assistant", ""), (1, 2, 1, 4, "delta", None, "B"), (1, 2, 1, 3, "delta", None, "A"),
         (1, 2, 1, 5, "regenerate", None, "ignored"), (1, 2, 1, 6, "delta", None, "C"), (1, 2, 1, 7, "delta", None, None), (1, 2, 1, 8, "delta", None, "D"),
         (1, 3, 2, 9, "start", "user", "old"), (1, 3, 2, 10, "edit", None, "new"), (1, 3, 2, 11, "delta", None, "!"), (1, 4, 3, 12, "start", "user", "x"), (1, 4, 3, 13, "delete", None, None),
         (1, 5, 4, 14, "delete", None, None), (1, 5, 4, 15, "start", "user", "back")]
    log = spark.createDataFrame(e, "conv_id long, msg long, turn long, seq long, kind string, role string, text string").repartition(4)
    got = sorted((r.turn, r.role, r.text) for r in chat_events.fold(log).collect())
    assert got == [(0, "user", "Hi you"), (1, "assistant", "CD"), (2, "user", "new!"), (4, "user", "back")]


@given(st.text(st.sampled_from(list("<>/s[]INST\\ ab")), max_size=30))
def test_escape_is_reversible(text):
    e = chat_events.escape(text)
    assert chat_events.unescape(e) == text and not any(c in e for c in chat_events.CONTROL)


# ---- packing -------------------------------------------------------------

def test_packing_keeps_every_token(spark):
    r = random.Random(6)
    rows = [(i, r.choice([0, 1, 7, 100, 255, 256, 300, 900, 2047, 2048, 2049, 10_000])) for i in range(400)] + [(5, 300), (None, 40), (77, None), (578, 100_000)]
    items = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, length long, bin_id string")
    bins = packing.pack(items, shard=60).collect()
    assert len({b.bin_id for b in bins}) == len(bins)
    seen = {}
    for b in bins:
        assert sum(b.lengths) == b.used <= b.capacity and b.capacity == next(c for c in packing.CAPACITIES if c >= b.used)
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            seen.setdefault(d, []).append((s, n))
    for d in {a for a, _ in rows}:
        assert sum(n for _, n in seen[d]) == sum(b or 0 for a, b in rows if a == d)
    assert [s for s, _ in sorted(seen[578])] == [k * 2048 for k in range(49)]
    assert packing.pack(items.limit(0)).count() == 0


def plain_best_fit(lengths, caps):
    """The rule of the operator with plain searches over all open bins."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left, bin_of, touched = [], {}, []
    for k, i in enumerate(order):
        n = lengths[i]
        open_bins = [b for b in range(len(left)) if left[b] >= n]
        if open_bins:
            r = min(left[b] for b in open_bins)
            b = max((b for b in open_bins if left[b] == r), key=lambda b: touched[b])  # of equal ones the last touched
        else:
            def score(c, n=n, k=k):
                return packing.cost(c) / max(1, min(c, n + sum(lengths[j] for j in order[k + 1:] if lengths[j] <= c - n)))
            left.append(min((c for c in caps if c >= n), key=lambda c: (score(c), c)))
            touched.append(k)
            b = len(left) - 1
        left[b] -= n
        touched[b] = k
        bin_of[i] = b
    return len(left), bin_of, left


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=40))
def test_best_fit_matches_plain_search(lengths):
    caps = (16, 32, 64)
    got, final = packing.best_fit(np.array(lengths, np.int64), caps)
    n, bin_of, left = plain_best_fit(lengths, caps)
    assert len(final) == n
    used = np.bincount(got, weights=lengths, minlength=n) if lengths else []
    want = np.bincount([bin_of[i] for i in range(len(lengths))], weights=lengths, minlength=n) if lengths else []
    assert sorted(used) == sorted(want) and all(c == next(x for x in caps if x >= u) for c, u in zip(final, used, strict=True))


# ---- pipeline ------------------------------------------------------------

def test_pipeline_stages(spark, docs_of, prose, tmp_path):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = out.collect()
        have = [tuple(r) for r in docs.collect()]
        assert 0 < len(kept) < len(have) and all(tuple(r) in have for r in kept)
        again = stage(spark, docs_of([(None, None), (1, ""), (1, ""), (2, prose(1, 300))], extra=True), sf)
        assert again.columns == docs_of([], extra=True).columns and again.count() <= 4
        assert stage(spark, docs_of([]), sf).count() == 0
    bins = cp.run(spark, sf).collect()
    assert {d for b in bins for d in b.doc_ids} <= {r.doc_id for r in docs.collect()}


def test_pipeline_keeps_one_of_each_group(spark, docs_of, prose):
    import corpus_pipeline as cp
    base = prose(1, 200)
    docs = docs_of([(9, base), (4, base + " more"), (4, base + " more"), (5, prose(2, 200)), (None, prose(2, 200)), (6, ""), (7, ""), (8, None)])
    got = sorted((r.doc_id, r.text or "") for r in cp.near_duplicates(spark, docs, "").collect())
    assert [(i, len(t) > 0) for i, t in got] == [(4, True), (5, True), (6, False), (7, False), (8, False)]


def test_packing_stage_edges(spark, docs_of, prose):
    import corpus_pipeline as cp
    rows = [(None, None), (1, ""), (1, ""), (2, prose(1, 300)), (2, prose(1, 300)), (3, prose(2, 5000)), (4, " \t")]
    pack = cp.STAGES[-1][1]
    bins = pack(spark, docs_of(rows, extra=True), "").collect()
    pieces = sorted(((d or -1), s, n) for b in bins for d, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True))
    assert pieces == sorted([(-1, 0, 1), (1, 0, 1), (1, 0, 1), (2, 0, 301), (2, 0, 301), (3, 0, 2048), (3, 2048, 2048), (3, 4096, 905), (4, 0, 1)])
    assert all(sum(b.lengths) == b.used <= b.capacity for b in bins)
    assert pack(spark, docs_of([]), "").count() == 0


def test_pipeline_moves_texts_of_possible_copies_only(spark, docs_of, prose, monkeypatch):
    """Where the table of copies is too large to be broadcast, a bitmap keeps other rows' texts where they are."""
    import corpus_pipeline as cp

    base = prose(7, 90).split()
    rows = [(i, prose(i, 60)) for i in range(1, 41)] + [(100 + i, " ".join([*base[:-1], f"x{i}"])) for i in range(5)] + [(100, " ".join([*base[:-1], "x0"])), (None, "q w")] * 2
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cp.near_duplicates(spark, docs_of(rows, extra=True), "")
        assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "q w"), *sorted(rows[:41])]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Join LeftAnti") == plan.count("Join LeftSemi") == 1 and plan.count("getbit") + plan.count("shiftright(words") >= 3


def test_pipeline_rows_do_not_depend_on_the_scan_layout(spark, docs_of, prose, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    rows = [(i, prose(i // 2, 200)) for i in range(40)] + [(50, ""), (None, None), (7, prose(3, 200)), (60, prose(60, 200))]
    for k in range(8):
        docs_of(rows[k::8] + ([(60, prose(60, 200))] if k < 3 else [])).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs, join = spark.read.parquet(str(tmp_path / "docs")), cp.jaccard_tree.jaccard_components

    def other_layout_later(*a, **b):
        found = join(*a, **b)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        return found

    monkeypatch.setattr(cp.jaccard_tree, "jaccard_components", other_layout_later)
    try:
        before = docs.rdd.getNumPartitions()
        got = cp.near_duplicates(spark, docs, "")
        kept = [(r.doc_id, r.text) for r in got.collect()]
        assert spark.read.parquet(str(tmp_path / "docs")).rdd.getNumPartitions() != before
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(i, prose(i // 2, 200)) for i in range(0, 40, 2)] + [(50, ""), (None, None), (60, prose(60, 200))]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_pipeline_drops_leaks(spark, docs_of):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = docs_of([(1, "before it " + item + " after"), (2, "clean words only here"), (3, None)], extra=True)
    assert sorted(r.doc_id for r in cp.decontamination(spark, docs, sf).collect()) == [2, 3]
