"""Main text of web pages, with wrappers inferred from the pages of each host.

A page becomes a stream of blocks, each with a slot: the names of the elements around it. Streams of one host are aligned
into a wrapper, in parts and then the parts with each other, a regular expression without unions: a slot that some pages lack becomes optional, a
group of slots that follows itself becomes repeated, and every block is a text slot. Each page is then read with the
wrapper of its host, which gives every block its field. A field is template if its texts stand, in the mean, on half of the
different pages that have it; repeated and optional fields are judged alike. Repeated groups are folded before streams are
counted, so that a host of any size is aligned from all its pages.

The text of a page is what stands in its article or main elements, or in its body if it has none. There the wrapper
decides: template goes, within articles too, and varying fields stay. Menus, headers and footers of the page, sidebars,
notices, adverts, form controls, scripts, styles and comments of readers vary as well, and are left out by tag and class.
A page of which the wrapper would leave less than a tenth is taken by the tag rules alone. Nothing is cut off.

A null or empty html has an empty text. A null url is a host of its own. Rows are taken one by one; other columns are not
looked at.
"""

from __future__ import annotations

import html as entities
import re

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from payproof.llm.tables import written

# A quote opens a value only right after the equals sign; elsewhere, and where it is never closed, it is a letter like others.
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    rf"<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?)*+)(>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
CLOSES = {
    "p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"},
    "dd": {"dt", "dd"}, "option": {"option"},
}
#: A new block element ends an open paragraph, but not beyond these.
SCOPES = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table td th tr ul".split())
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog footer head iframe input label legend menu nav noscript object option script search "
    "select style svg template textarea title".split()
)
#: Words of class, id and role that say what an element is for: all words of a name must be of these or of WHERE, the last of these.
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert comment comments respond "
    "replies disqus social share sharing related recommended popup modal overlay newsletter subscribe subscription widget "
    "pagination pager toolbar contentinfo complementary search dialog skip login signup".split()
)
WHERE = frozenset("site page main top bottom left right primary secondary global header".split())
#: An article within elements of these words is one of a reader.
READERS = frozenset("comment comments respond replies disqus".split())
MAIN = frozenset(("article", "main"))
MAIN_ROLES = frozenset(("main", "article"))
#: Zones while a page is read: left out softly, and an article within.
SOFT, WITHIN = 3, 4


def _left_out(name: str, attributes: dict[str, str], inside_main: bool) -> str:
    """Whether an element is left out: hard, soft (an article in it may still be the main text) or not at all (empty)."""
    if name in LEFT_OUT:
        return "hard"
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "hard"
    if name == "header" and not inside_main:
        return "soft"
    role = attributes.get("role", "").lower()
    if (name in MAIN or role in MAIN_ROLES) and not re.search(r"comment|repl(?:y|ies)", attributes.get("class", "") + attributes.get("id", "")):
        return ""
    if name in ("html", "body"):
        return ""
    for said in f"{attributes.get('class', '')} {attributes.get('id', '')} {role}".lower().split():
        words = re.findall(r"[a-z]+", said)
        if not words or not all(w in LEFT_OUT_WORDS or w in WHERE for w in words):
            continue
        if words[-1] in LEFT_OUT_WORDS:
            return "hard" if READERS & set(words) else "soft"
        if words[-1] == "header" and not inside_main:
            return "soft"
    return ""


def blocks(page: str) -> list[tuple[str, str, int]]:
    """Slot, text and zone (2: article, 1: other, 0: left out) of each block that has text.

    An article in an element left out softly is the main text if the page has no other article and less text beside it. So is
    all that stands in such elements if the page has no other text.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int]] = [("", "", 1)]  # name, slot, zone
    text: list[str] = []
    zone, slot = 1, ""

    def flush() -> None:
        if text and (joined := " ".join(entities.unescape("".join(text)).split())):
            out.append((slot, joined, zone))
        text.clear()

    at, n = 0, len(page)
    for match in iter(lambda: _TAG.search(page, at), None):
        text.append(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        block = name not in INLINE
        if block:
            flush()
        if match[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth and (block or not any(x[0] not in INLINE for x in stack[depth + 1 :])):
                flush() if stack[-1][2] != stack[depth - 1][2] else None
                del stack[depth:]
        else:
            if name in CLOSES or block:
                ends = CLOSES.get(name, set()) | ({"p"} if block and name != "br" else set())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPES - ends:
                        break
            attributes = {
                k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(match[3] or "")
            }
            _, above, around = stack[-1]
            inside_main = around in (2, WITHIN)
            role = attributes.get("role", "").lower()
            own = around
            out_by = _left_out(name, attributes, inside_main) if around else ""
            if out_by:
                own = SOFT if out_by == "soft" and around in (1, SOFT) else 0
            elif around in (1, SOFT) and (name in MAIN or role in MAIN_ROLES):
                own = 2 if around == 1 else WITHIN
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
                if name in ("noscript",) and close is None:
                    continue
                at = close.start() if close else n
                stack.append((name, above, 0))
                continue
            if name not in VOID and not (match[3] or "").endswith("/"):
                if own != around:
                    flush()
                kind = re.sub(r"\d+", "", ".".join(attributes.get("class", "").split()[:2]))
                here = above if not block else f"{above}/{name}{'.' + kind if kind else ''}"
                stack.append((name, here, own))
        if not text or not "".join(text).strip():
            _, slot, zone = stack[-1]
        elif stack[-1][2] != zone:
            flush()
            _, slot, zone = stack[-1]
    text.append(page[at:])
    flush()
    sizes = {z: sum(len(t) for _, t, zone in out if zone == z) for z in (1, 2, WITHIN)}
    reopened = 2 if not sizes[2] and sizes[WITHIN] > sizes[1] else 0
    final = {0: 0, 1: 1, 2: 2, SOFT: 0, WITHIN: reopened}
    if not any(sizes.values()):
        final[SOFT] = 1
    return [(s, t, final[z]) for s, t, z in out]


def folds(slots: Sequence[str], longest: int = 3) -> list[tuple[int, int]]:
    """How a stream is folded, in order: size of a group, and how often it follows itself."""
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(slots):
        for size in range(1, longest + 1):
            group = slots[i : i + size]
            j = i + size
            while slots[j : j + size] == group and len(group) == size:
                j += size
            if j > i + size:
                out.append((size, (j - i) // size))
                i = j
                break
        else:
            out.append((1, 1))
            i += 1
    return out


def folded(slots: Sequence[str], longest: int = 3) -> tuple[tuple[str, bool], ...]:
    """A stream in which groups that follow themselves stand once: (slots of the group joined by a space, repeated)."""
    out: list[tuple[str, bool]] = []
    i = 0
    for size, times in folds(slots, longest):
        out.append((" ".join(slots[i : i + size]), times > 1))
        i += size * times
    return tuple(out)


Item = tuple[str, bool, bool]  # group of slots, repeated, optional
#: Streams that are aligned into one partial wrapper, about, and partial wrappers into one of the next round.
PART_STREAMS, PART_WRAPPERS = 64, 16


def common(wrapper: Sequence[Item], page: Sequence[tuple[str, bool]]) -> list[list[int]]:
    """How many groups the rest of the wrapper and the rest of the page have in common, in order."""
    n, m = len(wrapper), len(page)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = best[i + 1][j + 1] + 1 if wrapper[i][0] == page[j][0] else 0
            best[i][j] = max(same, best[i + 1][j], best[i][j + 1])
    return best


def align(wrapper: Sequence[Item], page: Sequence[Item]) -> list[Item]:
    """The wrapper widened to take the page, or another wrapper, too: what only one side has becomes optional, what one side
    repeats, repeated."""
    n, m = len(wrapper), len(page)
    best = common(wrapper, page)
    out: list[Item] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and wrapper[i][0] == page[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((wrapper[i][0], wrapper[i][1] or page[j][1], wrapper[i][2] or page[j][2]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((wrapper[i][0], wrapper[i][1], True))
            i += 1
        else:
            out.append((page[j][0], page[j][1], True))
            j += 1
    merged: list[Item] = []
    for item in out:  # a group beside itself is one that repeats
        if merged and merged[-1][0] == item[0]:
            merged[-1] = (item[0], True, merged[-1][2] and item[2])
        else:
            merged.append(item)
    return merged


def fields_of(wrapper: Sequence[Item], page: Sequence[tuple[str, bool]]) -> list[int]:
    """For each group of a page its place in the wrapper; -1 for one that has none."""
    best = common(wrapper, page)
    out = [-1] * len(page)
    i = j = 0
    while i < len(wrapper) and j < len(page):
        if wrapper[i][0] == page[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out[j] = i
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def wrapper_of(streams: Sequence[Sequence[tuple[str, bool]]]) -> list[Item]:
    """Align streams one after the other."""
    return joined_wrappers([[(group, repeated, False) for group, repeated in stream] for stream in streams])


def joined_wrappers(wrappers: Sequence[list[Item]]) -> list[Item]:
    """One wrapper that takes what any of some takes."""
    out = list(wrappers[0]) if wrappers else []
    for wrapper in wrappers[1:]:
        out = align(out, wrapper)
    return out


def written_out(wrapper: Sequence[Item]) -> str:
    """A wrapper as text: a line for each group, after a mark for repeated and one for optional."""
    return "\n".join(f"{'+' if r else '.'}{'?' if o else '!'}{g}" for g, r, o in wrapper)


def read_in(wrapper: str) -> list[Item]:
    return [(line[2:], line[0] == "+", line[1] == "?") for line in wrapper.split("\n")] if wrapper else []


def expression(wrapper: Sequence[Item]) -> str:
    """The wrapper in usual notation, each slot with its text as #."""
    return " ".join(f"({' '.join(s + '#' for s in g.split())}){'+' if r else ''}{'?' if o else ''}" for g, r, o in wrapper)


MAIN_BLOCKS = "array<struct<item: int, part: int, text: string>>"
#: Different pages of a host that must have a field, and the share of them that its texts must stand on in the mean, before
#: it is taken for template.
LEAST_PAGES, SHARE = 5, 0.5
#: Share of its text that a page must keep, or else the wrapper is no evidence for it.
LEAST_LEFT = 0.1


def _block_udf():
    @arrow_udf(f"struct<stream: string, main: {MAIN_BLOCKS}>")
    def cut(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item", pa.int32()), ("part", pa.int32()), ("text", pa.string())]))
        streams, lists = [], []
        for page in pages:
            found = blocks(page.as_py() or "")
            slots = [s for s, _, _ in found]
            streams.append("\n".join(f"{'+' if r else '.'}{g}" for g, r in folded(slots)))
            places = [(i, k % size) for i, (size, times) in enumerate(folds(slots)) for k in range(size * times)]
            zone = 2 if any(z == 2 for _, _, z in found) else 1
            lists.append([{"item": i, "part": p, "text": t} for (i, p), (_, t, z) in zip(places, found, strict=True) if z == zone])
        return pa.StructArray.from_arrays([pa.array(streams, pa.string()), pa.array(lists, kind)], names=["stream", "main"])

    return cut.asNondeterministic()


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def cut_up(pages: DataFrame) -> DataFrame:
    """Every page with its host, folded stream, a hash of the stream, and the blocks that the tag rules take for main text.

    A block has its group in the folded stream and its part in that group.
    """
    return (
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("cut", _block_udf()("html"))
        .select("page_id", "url", "host", "cut.stream", F.xxhash64("cut.stream").alias("kind"), "cut.main")
    )


def _stream_items(stream: str) -> list[tuple[str, bool]]:
    return [(line[1:], line[0] == "+") for line in stream.split("\n")]


def wrappers(streams: DataFrame) -> DataFrame:
    """host and wrapper, inferred from all streams of the host; as a written table.

    Streams are dealt to parts of a bounded size; each part gives a partial wrapper, and these are aligned in
    rounds until each host has one. A host of very many different streams is many tasks.
    """

    def infer(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("n", "stream")), strict=True), key=lambda r: (-r[0], r[1]))
        return _one(group, wrapper_of([_stream_items(stream) for _, stream in rows]))

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("old", "wrapper")), strict=True))
        return _one(group, joined_wrappers([read_in(wrapper) for _, wrapper in rows]))

    def _one(group: pa.Table, wrapper: list[Item]) -> pa.Table:
        return group.slice(0, 1).select(["host", "part"]).append_column("wrapper", pa.array([written_out(wrapper)], pa.string()))

    schema = "host string, part bigint, wrapper string"
    parts = streams.groupBy("host").agg(F.ceil(F.count("*") / PART_STREAMS).alias("parts"))
    dealt = streams.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("kind"), "parts"))
    now = written(dealt.select("host", "part", "n", "stream").groupBy("host", "part").applyInArrow(infer, schema))
    while (now.agg(F.max("part")).first()[0] or 0) > 0:
        wider = now.select("host", F.col("part").alias("old"), F.floor(F.col("part") / PART_WRAPPERS).alias("part"), "wrapper")
        now = written(wider.groupBy("host", "part").applyInArrow(join, schema))
    return now.select("host", "wrapper")


def _fields_udf():
    @arrow_udf("array<int>")
    def places(streams: pa.Array, wrappers: pa.Array) -> pa.Array:
        known: dict[str, list[Item]] = {}
        out = []
        for stream, wrapper in zip(streams.to_pylist(), wrappers.to_pylist(), strict=True):
            if wrapper not in known:
                known = {wrapper: read_in(wrapper)}
            out.append(fields_of(known[wrapper], _stream_items(stream)))
        return pa.array(out, pa.list_(pa.int32()))

    return places.asNondeterministic()


def fields(seen: DataFrame) -> DataFrame:
    """For each host and stream the groups, each with its field: the place in the wrapper of the host."""
    streams = written(
        seen.where("stream <> ''").groupBy("host", "kind").agg(F.first("stream").alias("stream"), F.count("*").alias("n"))
    )
    placed = streams.join(wrappers(streams), "host").select("host", "kind", _fields_udf()("stream", "wrapper").alias("fields"))
    each = placed.select("host", "kind", F.posexplode("fields").alias("item", "field"))
    return written(each.where("field >= 0"))


def template(seen: DataFrame) -> DataFrame:
    """For each host and stream the blocks that are template, as group and part: constant fields, also repeated and optional ones.

    Equal pages of a host count once, so that copies of a page are no evidence.
    """
    placed = fields(seen)
    one = seen.select("host", "kind", "body", F.explode(F.array_distinct("marks")).alias("m")).select("host", "kind", "body", "m.*")
    both = one.join(placed, ["host", "kind", "item"]).select(
        "host", "field", "part", "body", F.explode(F.array(F.col("text_hash"), F.lit(None).cast("long"))).alias("text_hash")
    )
    # Pages of each text of a field, and those of the field itself as its null text.
    pages = both.distinct().groupBy("host", "field", "part", "text_hash").agg(F.count("*").cast("double").alias("n"))
    n, text = F.col("n"), F.col("text_hash").isNotNull()
    constant = (
        pages.groupBy("host", "field", "part")
        .agg(F.max(F.when(~text, n)).alias("pages"), F.sum(F.when(text, n)).alias("texts"), F.sum(F.when(text, n * n)).alias("squares"))
        .where((F.col("pages") >= LEAST_PAGES) & (F.col("squares") >= SHARE * F.col("texts") * F.col("pages")))
        .select("host", "field", "part")
    )
    return (
        placed.join(constant, ["host", "field"])
        .groupBy("host", "kind")
        .agg(F.collect_set(F.struct("item", "part")).alias("template"))
    )


def _size(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    cut = cut_up(pages)
    marks = F.transform("main", lambda b: F.struct(b["item"].alias("item"), b["part"].alias("part"), F.xxhash64(b["text"]).alias("text_hash")))
    seen = written(cut.select("host", "kind", "stream", marks.alias("marks")).withColumn("body", F.xxhash64(F.transform("marks", lambda m: m["text_hash"]))))
    # As a table, whose size is known: it goes to the pages where it is small, and else their hot streams are split.
    joined = cut.drop("stream").join(written(template(seen)), ["host", "kind"], "left")
    own = F.coalesce("template", F.array().cast("array<struct<item: int, part: int>>"))
    left = F.filter("main", lambda b: ~F.array_contains(own, F.struct(b["item"].alias("item"), b["part"].alias("part"))))
    # Near copies of a page look like template: of such pages hardly anything would be left.
    kept = F.when(_size(left) >= LEAST_LEFT * _size(F.col("main")), left).otherwise(F.col("main"))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"))
