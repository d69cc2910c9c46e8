"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by style: a node is a path of block elements with their
classes. Two entropies are taken of each node over the m pages that have it. Content: the features of
a node are its sentences (its whole blocks inside articles); one that k of the pages share has entropy log k / log m, and the node's
importance is one less the mean over its distinct sentences. So menus, adverts and notices, the same
on many pages, fall, and articles stay near one. The mean is taken twice, of the host's own pages and
of the pages of all hosts that have the path (still over the host's own sentences there), as much
furniture is common to hosts of which a few pages are known. Presentation: the entropy of the
node's child sequences. A branch counts CONTENT_SHARE of its content and the rest of its parent's
presentation. Branches that fall under LOW in either tree (in an article under LOW_IN_ARTICLE) are
removed from each page of the host. A tree of fewer than MIN_PAGES distinct pages says nothing.

What every page has of its own looks as important as an article: reader comments, adverts, forms, or
any furniture where too few pages are known. There, the names in the markup decide: whole elements
(navigation, forms and the like) and, outside articles, words in classes. Inside articles only
classes that are as a whole the name of an advert or of comments count.

Copies of a page count as one page, or a host of copies would take its article for a menu. A page
has SLOTS least hashes of the word triples of its article (without one, of all text outside named
furniture). It counts 1/c, where c pages of its host share ALIKE of these (ALIKE_WHOLE without an
article, where a long menu is shared too): so copies count as one together, near copies about as
one, and the numbers k and m are sums of such parts.

Trees are counted with partial sums by node and sentence, then by node; no task gets a whole host.
The branches to remove are broadcast up to BROADCAST_BYTES and joined by shuffle, split where skewed,
beyond.

Edge cases: a null or empty html gives an empty text; broken markup is read leniently (a new
paragraph or item closes the last one, an article closes open furniture, a head without end ends at
the first block, an element without end that is skipped takes nothing with it unless its content is
no markup, as a script's); repeated pages count as one page in the tree, each with its own row; very
long pages are read whole; an empty table gives no rows; a null url is the empty host; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, dropped, pieces, small_batches, written
from .url_rules import url_parts

CONTENT_SHARE = 0.9
LOW, LOW_IN_ARTICLE = 0.7, 0.05
MIN_PAGES = 4
SLOTS, ALIKE, ALIKE_WHOLE = 16, 8, 12
SALT = np.random.default_rng(8).integers(1 << 63, size=SLOTS + 5, dtype=np.uint64) | np.uint64(1)
#: Elements whose content is no markup: without an end they take the rest of the page.
RAW = ("script", "style", "title", "textarea", "iframe")
#: Elements that are left out whole.
SKIPPED = ("noscript", "template", "svg", "object", "select", "button")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside ad ads adbox advert adverts advertisement sponsor sponsored promo banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search breadcrumb breadcrumbs pager pagination related "
    "recommended share sharing social comment comments disqus respond replies widget toolbar masthead topbar skip".split()
)
#: Furniture of the page, but part of an article that has it inside.
OUTER = frozenset(("header",))
#: Whole class names that mark furniture inside an article, too.
INNER_NAMES = frozenset("ad ads adbox advert adverts advertisement sponsored comment comments comment-list disqus respond replies".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
INSIDE = r"(?>[^>\"']|\"[^\"]*\"|'[^']*')*"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){INSIDE}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{INSIDE})>|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
SKIPPED_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in SKIPPED}
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SENTENCE = re.compile(r"[.!?;:·•|]+(?:\s+|$)|\s+[·•|–—-]\s+")
SPACE = re.compile(r"\s+")


class Page:
    """Blocks of a page, (path, text, named furniture, in an article), and its elements' child sequences."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.children: dict[str, list[str]] = {}
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, furniture, in an article
        text: list[str] = []
        skipped_to, endless = 0, set()

        def close_block() -> None:
            if text:
                whole = SPACE.sub(" ", "".join(text)).strip()
                if whole:
                    _, path, furniture, article = stack[-1]
                    self.blocks.append((path, whole, furniture, article))
                text.clear()

        for m in TOKEN.finditer(source):
            if m.start() < skipped_to:
                continue
            piece = m["text"]
            if piece is not None:
                text.append(entities.unescape(piece) if "&" in piece else piece)
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                text.append(" ")
                continue
            if tag not in BLOCKS:
                if tag in SKIPPED_END and not m["end"] and tag not in endless:
                    end = SKIPPED_END[tag].search(source, m.end())
                    if end:
                        skipped_to = end.end()
                    else:
                        endless.add(tag)
                continue
            close_block()
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in ("article", "main") and tag not in ("body", "html"):
                        break
                continue
            if stack[-1][0] == "p":
                stack.pop()
            while stack[-1][0] in CLOSES.get(tag, ()):
                stack.pop()
            if tag in ("article", "main"):
                while len(stack) > 1 and stack[-1][2]:
                    stack.pop()
            _, above, furniture, article = stack[-1]
            whole, hidden = attributes(m["rest"]) if m["rest"] else ([], False)
            names = sorted({n for w in whole for n in re.split(r"[^a-z0-9]+", w) if n and not n.isdigit()})
            named = tag in FURNITURE_TAGS or hidden
            if article:
                named = named or not INNER_NAMES.isdisjoint(whole)
            else:
                named = named or tag in OUTER or not FURNITURE_NAMES.isdisjoint(names) or not OUTER.isdisjoint(names)
            style = ".".join([tag, *names])
            self.children.setdefault(above, []).append(style)
            if tag not in VOID:
                stack.append((tag, f"{above}/{style}", furniture or named, article or tag in ("article", "main")))
        close_block()


def attributes(rest: str) -> tuple[list[str], bool]:
    """The whole names in class, id and role, and whether the element is hidden."""
    names: list[str] = []
    hidden = False
    for name, *values in ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in ("class", "id", "role"):
            names += "".join(values).lower().split()
        hidden = hidden or name == "hidden" or name == "style" and HIDDEN.search("".join(values)) is not None
    return names, hidden


def code(text: str) -> int:
    x = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (x >> 63 << 64)


def nodes(page: Page) -> list[tuple[str, bool, list[int]]]:
    """path, whether it is of elements, and codes of the node's features: sentences of a text, the child sequence of elements."""
    found: dict[str, set[str]] = {}
    for path, text, _, article in page.blocks:
        found.setdefault(path, set()).update([text] if article else [x for x in SENTENCE.split(text) if x] or [text])
    # a code is of the path, too, so that it stands for the same on all hosts
    out = [(path, False, [code(f"{path} {x}") for x in own]) for path, own in found.items()]
    return out + [(path, True, [code(f"{path}> {' '.join(dict.fromkeys(c))}")]) for path, c in page.children.items()]


def sketch(page: Page) -> tuple[bool, list[int]]:
    """Whether the page has an article with text, and the least hashes of its word triples."""
    own = [t for _, t, furniture, article in page.blocks if article and not furniture]
    words = " ".join(own or [t for _, t, furniture, _ in page.blocks if not furniture]).split()
    words += [""] * (3 - len(words))
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    grams = h[:-2] * SALT[0] + h[1:-1] * SALT[1] + h[2:] * SALT[2]
    grams = np.unique((grams ^ (grams >> np.uint64(29))) * SALT[3])
    least = np.full(SLOTS, ~np.uint64(0))
    for k in range(0, len(grams), 4096):
        x = (grams[k : k + 4096, None] ^ SALT[5:]) * SALT[4]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return bool(own), least.view(np.int64).tolist()


def features(pages: DataFrame) -> DataFrame:
    """A row for each page: host, article and slots (its sketch), and its nodes."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("inner", pa.bool_()), ("codes", pa.list_(pa.int64()))]))
    schema = pa.schema([("host", pa.string()), ("article", pa.bool_()), ("slots", pa.list_(pa.int64())), ("nodes", kind)])

    def run(batches):
        for b in pieces(batches):
            rows = []
            for name, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source)
                rows.append((name, *sketch(page), [{"path": p, "inner": i, "codes": c} for p, i, c in nodes(page)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return pages.select("host", "html").mapInArrow(run, "host string, article boolean, slots array<long>, nodes array<struct<path string, inner boolean, codes array<long>>>")


def page_parts(parsed: DataFrame) -> DataFrame:
    """sketch and part: what a page of this sketch counts, 1/c of a page for c pages alike."""
    each = parsed.groupBy("host", "article", "slots", "sketch").agg(F.count(F.lit(1)).alias("n")).select("host", "article", "sketch", "n", F.explode("slots").alias("slot"))
    alike = each.groupBy("host", "article", "slot").agg(F.sum("n").alias("c"))
    c = each.join(alike, ["host", "article", "slot"]).groupBy("sketch", "article").agg(F.sort_array(F.collect_list("c"), False).alias("c"))
    return c.select("sketch", (1 / F.get("c", F.when(F.col("article"), ALIKE - 1).otherwise(ALIKE_WHOLE - 1))).alias("part"))


def importances(pages: DataFrame) -> DataFrame:
    """host, path, m and m_all (distinct pages with the node, of the host and of all), importance and importance_all of every node with text.

    Sums of parts and of logarithms are rounded, so that their order changes nothing.
    """
    parsed = written(features(pages).withColumn("sketch", F.xxhash64("host", "article", "slots")), "style-pages")
    parts = written(page_parts(parsed), "style-parts")
    has = parsed.join(parts, "sketch").select("host", "part", F.inline("nodes")).withColumn("node", F.xxhash64("host", "path", "inner"))
    total = lambda c: F.round(F.sum(c), 6)
    ln = lambda c: F.log(F.greatest(F.col(c), F.lit(1)))
    own = has.groupBy("node").agg(total("part").alias("m"), F.first("host").alias("host"), F.first("path").alias("path"), F.first("inner").alias("inner"))
    counts = written(has.select("node", "part", F.explode("codes").alias("code")).groupBy("node", "code").agg(total("part").alias("k")), "style-counts")
    # most features are of one node alone: only the others have more pages elsewhere
    shared = written(counts.groupBy("code").agg(total("k").alias("k_all"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("code", "k_all"), "style-shared")
    known = counts.join(broadcast_if_small(shared, F.lit(24)), "code", "left").withColumn("k_all", F.coalesce("k_all", "k"))
    sums = known.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), total(ln("k")).alias("logs"), total(ln("k_all")).alias("logs_all"), total(F.col("k") * F.log("k")).alias("turns"), total(F.col("k") * F.log("k_all")).alias("cross")
    )
    nodes_ = written(own.join(sums, "node"), "style-nodes")
    for table in (parsed, parts, counts, shared):
        dropped(table)
    # summed over the nodes of a path, k log k_all gives k_all log k_all of each feature once
    everywhere = nodes_.groupBy("path", "inner").agg(total("m").alias("m_all"), total("cross").alias("turns_all"))
    full = nodes_.join(everywhere, ["path", "inner"])
    size = lambda m: F.log(F.greatest(F.col(m), F.lit(2)))
    content = lambda logs, m: F.when(F.col(m) <= 1, 1.0).otherwise(1 - F.col(logs) / (F.col("n") * size(m)))
    shape = lambda turns, m: F.when(F.col(m) <= 1, 1.0).otherwise(F.least(F.lit(1.0), (F.log(m) - F.col(turns) / F.col(m)) / size(m)))
    texts = full.where(~F.col("inner")).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    shapes = full.where("inner").select("host", F.col("path").alias("parent"), shape("turns", "m").alias("shape"), shape("turns_all", "m_all").alias("shape_all"))
    blend = lambda c, s: F.round(CONTENT_SHARE * c + (1 - CONTENT_SHARE) * F.coalesce(s, F.lit(1.0)), 6)
    return texts.join(shapes, ["host", "parent"], "left").select(
        "host", "path", "m", "m_all", blend(content("logs", "m"), F.col("shape")).alias("importance"), blend(content("logs_all", "m_all"), F.col("shape_all")).alias("importance_all")
    )


def low_branches(pages: DataFrame) -> DataFrame:
    """host and low: the nodes whose branches go."""
    bound = F.when(F.col("path").rlike("/(article|main)[./]|/(article|main)$"), LOW_IN_ARTICLE).otherwise(LOW)
    low = (F.col("m") >= MIN_PAGES) & (F.col("importance") < bound) | (F.col("m_all") >= MIN_PAGES) & (F.col("importance_all") < bound)
    return importances(pages).where(low).groupBy("host").agg(F.collect_set("path").alias("low"))


def main_text(page: Page, gone: set[str], names: bool = True) -> str:
    """What is left without the removed branches and, unless names is false, without what its markup names as furniture."""
    return " ".join(t for p, t, furniture, _ in page.blocks if not (names and furniture) and p not in gone)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages)
    host, _ = url_parts(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = low_branches(named)
    low = written(found, "low-branches")
    dropped(found, "style-nodes")
    low = broadcast_if_small(low, F.length("host") + F.length(F.concat_ws("", "low")) + 64)

    def run(batches):
        for b in pieces(batches):
            texts = []
            for source, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                gone = set(gone or ())
                texts.append(main_text(Page(source), gone))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return named.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")
