"""Plain versions beside the operators: the selection of page text by definition, and a sample-by-sample reader of media files."""

import random
import struct

import pytest

from gaugewright.llm import html, media

# ---- the selection of op8, block by block


def above(node):
    out = []
    while node is not None:
        out.append(node)
        node = node.up
    return out


def plain_main_text(page):
    """main_text() with sets of ancestors and sums over blocks in place of places and passes; figures() has a test of its own."""
    blocks, nodes = html.blocks(page)
    if not blocks:
        return ""
    own, smooth = html.figures(blocks)
    clear = [s for (n, _, _), s in zip(blocks, smooth, strict=True) if n.doubt != html.SURE]
    best, most = max(clear, default=0.0), max(smooth)

    def bar(node):
        if node.doubt == html.SURE:
            return best or html.FLOOR
        return max(html.SHARE * most, html.FLOOR) if node.doubt else html.SHARE * (best or most)

    chosen = [s > 0 and s >= bar(b[0]) for b, s in zip(blocks, smooth, strict=True)]
    strong = [c and o >= bar(b[0]) for b, c, o in zip(blocks, chosen, own, strict=True)]
    if not any(chosen):
        return ""
    mass = lambda node: sum(len(t) for (n, t, _), c in zip(blocks, chosen, strict=True) if c and node in above(n))
    total = sum(len(t) for (_, t, _), c in zip(blocks, chosen, strict=True) if c)
    deep = [n for n in nodes if mass(n) >= 0.8 * total]
    holder = next(n for n in deep if n.depth == max(m.depth for m in deep))
    inner = "p li ul ol td tr tbody table blockquote pre dl dd dt h1 h2 h3 h4 h5 h6".split()
    while holder.name in inner and holder.up is not None and holder.up.name not in ("", "html", "body"):
        holder = holder.up
    holder = next((n for n in above(holder) if n.content), holder)
    outside = above(holder)[1:]

    def part(node):
        """The holder, an element around it, or the outermost one beside those."""
        if holder in above(node):
            return holder
        if node in outside:
            return node
        return next(n for n in above(node) if n.up is None or n.up in outside)

    beside = [part(b[0]) for b, s in zip(blocks, strong, strict=True) if s]
    taken = [holder, *(n for n in beside if n.within or not holder.article)]
    firm = [s for b, s in zip(blocks, smooth, strict=True) if b[0].doubt <= holder.doubt]

    def stays(node):
        if node.doubt <= holder.doubt:
            return True
        same = [(o, len(t)) for (n, t, _), o in zip(blocks, own, strict=True) if n.doubt > holder.doubt and n.part is node.part]
        mean = sum(o * size for o, size in same) / sum(size for _, size in same)
        share = 0.0 if node.doubt == html.TOPIC else html.SHARE * html.PRIOR[html.NAMED] if node.doubt == html.NAMED else 1.0
        return mean >= max(html.FLOOR, share * max(firm, default=0.0))

    whole = holder.name in ("", "html", "body")
    hits = [i for i, s in enumerate(strong) if s] or [0, len(blocks)]

    def menu(node):
        """Links for the most part, before or after all content, where the whole page is the holder."""
        if not whole or node is holder:
            return False
        top = lambda n: next((m for m in above(n) if m.up is holder), None) or above(n)[-1] if holder in above(n) else above(n)[-1]
        same = [(i, len(t), linked) for i, (n, t, linked) in enumerate(blocks) if n is not holder and top(n) is top(node)]
        return not any(hits[0] <= i <= hits[-1] for i, _, _ in same) and sum(x[2] for x in same) > sum(x[1] for x in same) / 2

    out = []
    for (node, text, _), c in zip(blocks, chosen, strict=True):
        title = node.name in html.HEADINGS and node.up is holder.up and (node.content or node.name == "h1") and not node.doubt
        where = part(node)
        here = any(where is n for n in taken) and (stays(node) if where is holder else c or not node.doubt)
        if (title or here) and not (menu(node) and not title):
            out.append(text)
    return " ".join(out)


def made(rng):
    """A page of random boxes: named and unnamed, with sentences, links, lists and headings."""
    sentence = lambda: " ".join(rng.choice(["one", "two", "three", "so,", "end."]) for _ in range(rng.randint(1, 40)))
    names = ["", "", "", ' class="menu"', ' class="comments"', ' id="related"', ' class="post-content"', ' class="ad"', ' class="share legal"', ' class="x y"', " hidden"]

    def box(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.45:
            tag = rng.choice(["p", "p", "h1", "h2", "li", "blockquote"])
            text = sentence() if rng.random() < 0.7 else f'<a href="x">{sentence()}</a>'
            return f"<{tag}{rng.choice(names) if rng.random() < 0.2 else ''}>{text}</{tag}>"
        tag = rng.choice(["div", "div", "section", "article", "nav", "ul", "aside", "main"])
        return f"<{tag}{rng.choice(names)}>" + "".join(box(depth + 1) for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    return "<body>" + "".join(box(0) for _ in range(rng.randint(1, 6))) + "</body>"


def test_selection_brute_force(spark):
    rng = random.Random(17)
    pages = [made(rng) for _ in range(400)]
    pages += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20).collect()] + ["", "<p>", "text alone", "<nav>a, b.</nav>"]
    texts = [html.main_text(p)[0] for p in pages]
    assert texts == [plain_main_text(p) for p in pages]
    assert sum(bool(t) for t in texts) > 300


LONG = "Paragraph of the text, which is long, has commas, and says something. " * 6
SAID = "It has sentences, more than one, and belongs to the text. They go on for a while, with commas, as texts do."


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold, as said.</p>", "Let x=2 hold, as said."),
        ("<p>With <math><semantics><mi>y</mi><annotation>y_tex</annotation></semantics></math>.</p>", "With y."),
        (f"<blockquote class='comment'>{SAID}</blockquote>", SAID),
        (f"<div class='menu'><p>{SAID}</p></div>", SAID),
        ("<div class='menu'><a href=a>Home</a><a href=b>News</a></div>", ""),
        (f"<div class='comments'><p>{SAID}</p></div>", ""),
        (f"<ul class='commentlist'><li class='comment'>{SAID}</li></ul>", ""),
        (f"<div class='advert'><p>{SAID}</p></div>", ""),
    ],
)
def test_names_within_the_text(inside, text):
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p>{inside}<p>{LONG}</p></article></body></html>"
    whole = " ".join(f"Title {LONG} {text} {LONG}".split())
    assert html.main_text(page)[0] == whole


def test_unnamed_boxes_beside_an_article():
    """A notice about cookies and remarks of readers that no name tells: the article says that it is the text."""
    for more in ("<div><p>We use cookies, as most pages do. Read on, or leave.</p></div>", f"<div><p>{SAID}</p></div><div><p>{SAID}</p></div>"):
        page = f"<html><body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>{more}</body></html>"
        assert html.main_text(page)[0] == " ".join(f"Title {LONG} {LONG} {LONG} {LONG}".split())


# ---- a reader of ISO files that goes by the tables, sample by sample


def box(data, path, start=0, end=None):
    """The body of the first box along a path of four-letter names."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        if name == path[0]:
            return data[at + 8 : at + size] if len(path) == 1 else box(data, path[1:], at + 8, at + size)
        at += size
    raise KeyError(path)


def samples(data):
    """(start, size, time, keyframe) of each sample of the first track, and its timescale."""
    stbl = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
    table = lambda name: box(data, (*stbl, name))[4:]  # noqa: E731  after version and flags
    number = lambda t, i: struct.unpack(">I", t[4 * i : 4 * i + 4])[0]
    stsz, stts, stsc, stss = (table(n) for n in (b"stsz", b"stts", b"stsc", b"stss"))
    sizes = [number(stsz, 0) or number(stsz, 2 + i) for i in range(number(stsz, 1))]
    times = [number(stts, 2 + 2 * r) for r in range(number(stts, 0)) for _ in range(number(stts, 1 + 2 * r))]
    try:
        stco = table(b"stco")
        chunks = [number(stco, 1 + i) for i in range(number(stco, 0))]
    except KeyError:
        co64 = table(b"co64")
        chunks = [struct.unpack(">Q", co64[4 + 8 * i : 12 + 8 * i])[0] for i in range(number(co64, 0))]
    keys = {number(stss, 1 + i) for i in range(number(stss, 0))}
    runs = [(number(stsc, 1 + 3 * r), number(stsc, 2 + 3 * r)) for r in range(number(stsc, 0))]
    out, at, time = [], 0, 0
    for c, place in enumerate(chunks, 1):
        for _ in range(next(n for first, n in reversed(runs) if first <= c)):
            out.append((place, sizes[at], time, at + 1 in keys))
            place, time, at = place + sizes[at], time + times[at], at + 1
    mdhd = box(data, stbl[:3][:-1] + (b"mdia", b"mdhd"))
    return out, struct.unpack(">I", mdhd[20:24] if mdhd[0] else mdhd[12:16])[0]


@pytest.mark.parametrize("n", [1, 2, media.KEY, media.KEY + 1, 5 * media.KEY + 3])
def test_sample_tables_by_another_reader(n):
    payload = bytes(random.Random(n).randrange(256) for _ in range(576 * n))
    data = bytes(media.movie(payload))
    found, scale = samples(data)
    (track,) = media.tracks(data)
    assert [(a, s, k) for a, s, _, k in found] == [(int(a), int(s), bool(k)) for a, s, k in zip(track.starts, track.sizes, track.sync, strict=True)]
    assert b"".join(data[a : a + s] for a, s, _, _ in found) == payload
    starts, ends = track.keyframes()
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(a, a + s) for a, s, _, k in found if k]
    times = [0, *track.ticks.cumsum().tolist()][:-1]
    assert times == [t for _, _, t, _ in found] and scale == track.scale
    assert abs(track.seconds - (times[-1] + int(track.ticks[-1])) / scale) < 1e-9


# ---- tokens by the vocabulary's own bytes


def vocabulary_bytes(tokenizer, ids):
    """The bytes of each id: a vocabulary's signs stand for bytes, printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return [bytes(signs[c] for c in tokenizer.id_to_token(i)) for i in ids]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_tokens_of_sections_byte_by_byte(spark, rule):
    """Texts in several scripts, whose signs are cut by tokens, with breaks anywhere: each byte knows its section."""
    from tokenizers import Tokenizer

    from gaugewright.llm import tokens
    from gaugewright.llm.queries import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(23)
    signs = ["word", " and", "\n", "\n\n", "é", "ß ", "日本語", "🙂", "👩‍👩‍👧", "́", " 12 345", "\r\n", "\t", "Ünï", "x" * 30, "العربية"]
    rows = [(i, "".join(rng.choices(signs, k=rng.randint(0, 40))), rng.choice(["en", None, "é\nn"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {}
    for r in tokens.count_tokens(frame, tokenizer_path(), ["lang", "text"], rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r
    for i, text, lang in rows:
        whole = f"{lang or ''}\n{text}".encode()
        section = [0]  # of each byte: a break belongs to the section that it ends
        for b in whole[:-1]:
            section.append(section[-1] + (b == 10))
        n = whole.count(b"\n") + 1
        counts, crossing, at = [0] * n, [0] * n, 0
        ids = tokenizer.encode(whole.decode(), add_special_tokens=False).ids
        for token in vocabulary_bytes(tokenizer, ids):
            where = section[at : at + len(token)]
            owner = where[0] if rule == "first" else max(sorted(set(where)), key=where.count)
            counts[owner] += 1
            crossing[owner] += len(set(where)) > 1
            at += len(token)
        assert at == len(whole)
        assert [got[i][k]["tokens"] for k in range(n)] == counts
        assert [got[i][k]["crossing"] for k in range(n)] == crossing
        assert sorted(got[i]) == list(range(n)) and got[i][0]["doc_tokens"] == len(ids)
