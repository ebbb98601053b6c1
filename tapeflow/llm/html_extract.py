"""Main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Scratch, bounded, sized, tidy

#: Hosts with fewer pages have no template; least share of a group's pages that a template token is on; share of the pages
#: with content on which a text counts as template text, and on which an article must be for the others to be left out.
HOST_PAGES, SUPPORT, COMMON = 3, 0.3, 0.9
#: Share of a host's text that a container must hold to be its main slot; share of a page's text from which a marked element is
#: taken for the page's content all the same (for reader comments the second); shares of text in links that make a list of
#: links, of an element with a mark and of any other, and the links that the latter has at least.
MAIN, CONTENT, COMMENTS_ONLY, LINKED, MENU, MENU_LINKS = 0.8, 0.5, 0.9, 0.5, 0.8, 3

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset(
    "html head body nav header footer aside main article section div form ul ol dl menu table figure title button select label dialog "
    "noscript iframe svg template blockquote fieldset details".split()
)
RAW = frozenset("script style textarea".split())
LEFT_OUT = frozenset("head title nav footer aside menu dialog noscript iframe svg template button select label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Elements that no mark can take out.
PAGE = frozenset("html body main article".split())
#: Elements that an opening element of the name closes.
CLOSES = {
    **{b: frozenset(["p"]) for b in BLOCKS},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
}
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
MARKS = ADVERTS | COMMENTS | frozenset(
    "banner breadcrumb breadcrumbs consent cookie cookies footer masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay paywall popup promo promotion related share sharing sidebar social subscribe toolbar widget".split()
)
#: Parts of a compound name that say that something is not there, and first parts that tell how a page is laid out.
NEGATIONS = frozenset("no non not without off free less hide disabled closed none".split())
LAYOUTS = frozenset("has with show is js enable enabled".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: What is known of an element from its tag: nothing, that it is no content, a mark, reader comments, a mark that is only a part of a
#: name, a form.
PLAIN, NONE, MARKED, READERS, HINT, FORM = range(6)


def _mark(names: str) -> int:
    """What class and id names say: a whole name counts, of a compound one what is not negated."""
    found = PLAIN
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        whole = name.lower() in MARKS
        if not whole and (len(parts) < 2 or parts[0] in LAYOUTS or not NEGATIONS.isdisjoint(parts)):
            continue
        own = MARKS.intersection(parts)
        if own & COMMENTS:
            return READERS
        if whole or own & ADVERTS:
            found = MARKED
        elif own and found == PLAIN:
            found = HINT
    return found


def _kind(name: str, attributes: str, inside: bool) -> tuple[int, str]:
    """What a tag says of its element, and its class and id words."""
    words, kind = "", PLAIN
    if attributes.strip():
        given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        names = f"{given.get('class', '')} {given.get('id', '')}"
        words = " ".join(_WORDS.findall(names.lower()))
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").lower().replace(" ", "")
        if hidden and name not in ("html", "body"):
            return NONE, words
        if name not in PAGE:
            kind = NONE if given.get("role", "").lower() in ROLES else _mark(names)
            if kind == PLAIN and not inside and "header" in names.lower().split():
                kind = MARKED
    if name in LEFT_OUT or (name == "header" and not inside):
        return NONE, words
    return (FORM if name == "form" and kind == PLAIN else kind), words


def events(page: str):
    """The page as a list of (token, text, block, out, main, element), and the parents of its elements.

    An item is a tag's token or a text; the rest says whether a tag ends a block, whether what follows lies in an element that is left
    out, and in an article or main element, and in which element. A token is the tag and a hash of the path of containers
    around it. Which elements are left out is told when the whole page is read (:func:`_left_out`)."""
    # Of each open container: its name, the hash of the path to it, its element, and the open elements in it that are no containers,
    # as (name, element around them), with the number of each name among them.
    stack: list = [("", 0, 0, [], defaultdict(int))]
    opened: dict[str, int] = defaultdict(int)
    parents, kinds, mains, texts, links, anchors = [-1], [PLAIN], [False], [0], [0], [0]
    found, linked, at = [], 0, 0

    def element(parent: int, kind: int, main: bool) -> int:
        parents.append(parent), kinds.append(kind), mains.append(main or mains[parent])
        texts.append(0), links.append(0), anchors.append(0)
        return len(parents) - 1

    def shut(frame, size: int) -> int:
        """Closes the open elements of a container from place ``size`` on; gives the links among them."""
        gone = 0
        _, _, _, inner, counts = frame
        while len(inner) > size:
            name, _ = inner.pop()
            counts[name] -= 1
            gone += name == "a"
        return gone

    def last(frame, names) -> int:
        inner, counts = frame[3], frame[4]
        if not any(counts[n] for n in names):
            return -1
        return next(i for i in range(len(inner) - 1, -1, -1) if inner[i][0] in names)

    while True:
        tag = _TAG.search(page, at)
        end = tag.start() if tag else len(page)
        frame = stack[-1]
        now = frame[3][-1][1] if frame[3] else frame[2]
        if end > at:
            text = page[at:end]
            size = len(text.strip())
            texts[now] += size
            links[now] += size if linked else 0
            found.append(("", text, False, now))
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if not closing and name in RAW:
            close = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        path = frame[1]
        if closing:
            token = f"{path}</{name}>"
            if name in CONTAINERS:
                if opened[name]:
                    gone = ""
                    while gone != name:
                        linked -= shut(stack[-1], 0)
                        gone = stack.pop()[0]
                        opened[gone] -= 1
            elif (place := last(frame, (name,))) >= 0:
                linked -= shut(frame, place)
        else:
            if name in CLOSES and (place := last(frame, CLOSES[name])) >= 0:
                linked -= shut(frame, place)
                now = frame[3][-1][1] if frame[3] else frame[2]
            kind, words = _kind(name, attributes, mains[now])
            token = f"{path}<{name} {words}>"
            if name == "a":
                anchors[now] += 1
            if not attributes.rstrip().endswith("/") and name not in VOID:
                main = name in ("article", "main")
                if name in CONTAINERS:
                    stack.append((name, _hash(f"{path}/{name}"), element(now, kind, main), [], defaultdict(int)))
                    opened[name] += 1
                else:
                    frame[3].append((name, element(now, kind, False) if kind else now))
                    frame[4][name] += 1
                    linked += name == "a"
        frame = stack[-1]
        found.append((token, "", name in BLOCKS, frame[3][-1][1] if frame[3] else frame[2]))
    out = _left_out(parents, kinds, mains, texts, links, anchors)
    return [(token, text, block, out[e], mains[e], e) for token, text, block, e in found], parents


def _left_out(parents: list[int], kinds: list[int], mains: list[bool], texts: list[int], links: list[int], anchors: list[int]) -> list[bool]:
    """For each element whether it is left out, from what its tag says and how much of the page's text it holds.

    Hidden elements and those that are never content are. A mark takes an element out unless it holds the page's article or
    most of its text; a name that only hints at something, inside an article, if its text is mostly links; outside
    of articles, a list of links is left out whatever its name."""
    n, holds = len(parents), [False] * len(parents)
    hard, shown = [False] * n, 0
    for e in range(1, n):
        hard[e] = hard[parents[e]] or kinds[e] == NONE
        shown += 0 if hard[e] else texts[e]
    shown += texts[0]
    texts, links, anchors = list(texts), list(links), list(anchors)
    for e in range(n - 1, 0, -1):
        up = parents[e]
        holds[up] = holds[up] or holds[e] or (mains[e] and not mains[up])
        if not hard[e]:
            texts[up], links[up], anchors[up] = texts[up] + texts[e], links[up] + links[e], anchors[up] + anchors[e]
    out = list(hard)
    for e in range(1, n):
        if out[parents[e]]:
            out[e] = True
        if out[e] or holds[e]:
            continue
        kind, content = kinds[e], texts[e] > CONTENT * shown
        if kind == READERS:
            out[e] = texts[e] <= COMMENTS_ONLY * shown
        elif kind in (MARKED, FORM) or (kind == HINT and not mains[e]):
            out[e] = not content
        elif kind == HINT:
            out[e] = links[e] >= LINKED * texts[e]
        elif not mains[e]:
            out[e] = anchors[e] >= MENU_LINKS and links[e] >= MENU * texts[e] and not content
    return out


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def page_tokens(page: str | None) -> list[tuple[int, int, float, bool, bool, bool, int]]:
    """(token, count, mean place, is text, left out after it, in a main element after it, characters)
    for each distinct tag token and text of a page; places run from 0 to 1. The characters of an opening
    container are those of the content in it, of a text its own; the token 0 has those of the page."""
    seen: dict[int, list] = {}
    found, parents = events(page or "")
    chars, opening = [0] * len(parents), set()
    for i, (token, text, _, out, main, e) in enumerate(found):
        if not token:
            text = _clean(text)
            if not text:
                continue
            chars[e] += 0 if out else len(text)
        key = _hash(token or "\0" + text)
        entry = seen.setdefault(key, [0, 0.0, not token, out, main, 0, e])
        if token[token.find("<") + 1 : token.find(" ")] in CONTAINERS:
            opening.add(key)
        entry[0] += 1
        entry[1] += i / len(found)
        entry[5] += 0 if token or out else len(text)
    for e in range(len(parents) - 1, 0, -1):
        chars[parents[e]] += chars[e]
    rows = []
    for k, (n, place, is_text, out, main, size, e) in seen.items():
        if e > 0 and n == 1 and k in opening:
            size = chars[e]
        rows.append((k, n, place / n, is_text, out, main, size))
    if any(r[3] for r in rows):
        rows.append((0, 1, 0.0, True, True, False, chars[0]))
    return rows


def extract(page: str | None, slots: dict[int, bool], template_texts: set[int], main_only: bool, main_slot: int | None = None) -> str:
    """Text of the kept slots of a page. ``slots`` says for each template token whether
    the slot after it is kept; tags that are not in the template only part blocks, and
    elements that are left out on this page alone are skipped too. If the container that ``main_slot``
    opens is on the page, what lies outside of it is left out."""
    blocks, held = [], []
    keep, (found, parents) = True, events(page or "")
    main_only = main_only and any(x[4] for x in found)
    inside = None
    if main_slot is not None:
        top = next((e for token, *_, e in found if token and token[-2:] != "/>" and _hash(token) == main_slot), None)
        if top is not None:
            inside = [False] * len(parents)
            for e in range(1, len(parents)):
                inside[e] = e == top or inside[parents[e]]

    def close():
        if held and (text := _clean("".join(held))):
            blocks.append(text)
        held.clear()

    for token, text, block, out, main, e in found:
        if token:
            known = slots.get(_hash(token))
            if known is not None:
                keep = known
            elif block:
                keep = keep or not out
            if block:
                close()
            elif token.endswith("<br >"):
                held.append(" ")
        elif keep and not out and (main or not main_only) and (inside is None or inside[e]):
            if not (template_texts and _hash("\0" + _clean(text)) in template_texts):
                held.append(text)
    close()
    return "\n".join(blocks)


def nested_template(tokens: pd.DataFrame) -> pd.DataFrame:
    """The template of one group of pages from its tokens (token, vector, n, most, place,
    is_text, out, main, chars, pages, total): classes of tokens with one occurrence vector,
    nested from the best supported down. A class is valid if each of its tokens is once on
    the pages that have it and all fall into one slot of the template so far, or, for the
    first class, if it is on the most pages. Crossing classes are left out; texts that are
    on nearly every page are template text wherever they stand, unless they are most of what the
    host has, as where its pages are copies of one article."""
    common = tokens[tokens["is_text"] & (tokens["n"] >= tokens["pages"] * COMMON)]
    if common["chars"].sum() > COMMON * tokens["total"].iloc[0]:
        common = common.iloc[:0]
    tokens = tokens[(tokens["most"] == 1) & ~tokens["is_text"]].sort_values(["n", "place", "token"], ascending=[False, True, True])
    kept, places = [common], []
    for (n, _), c in tokens.groupby(["n", "vector"], sort=False):
        own = c["place"].tolist()
        if n == tokens["n"].iloc[0] or len({bisect.bisect_left(places, p) for p in own}) == 1:
            places = sorted(places + own)
            kept.append(c)
    return pd.concat(kept).sort_values("place", kind="stable")


def main_slot(template: pd.DataFrame) -> int | None:
    """The template token whose container holds at least ``MAIN`` of the host's content, the innermost of those that do:
    the one with the least text, of equals the one that opens last. None if the content is spread."""
    opening = template[~template["is_text"] & (template["chars"] >= template["total"] * MAIN) & (template["total"] > 0)]
    opening = opening.sort_values(["chars", "place"], ascending=[True, False])
    return int(opening["token"].iloc[0]) if len(opening) else None


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    1. Every page gives its tokens: tags with the path around them, and texts. For each
       host and token, sums over all pages give the fingerprint of its occurrence vector;
       equal fingerprints make a class. A host with a third of all pages is only summed.
    2. Classes that occur once a page are nested into the host's template. Hosts with fewer than
       ``HOST_PAGES`` pages show no recurrence, so they have no template; nor have pages without a host.
    3. Template tokens part a page into slots. The innermost container of the template that holds
       ``MAIN`` of the host's content is its main slot: on pages that have it, what lies outside is
       left out, whatever its elements are called. So is text that stands on at least ``COMMON`` of a
       host's pages with content, unless the host has little else.
    4. On each page, hidden elements, menus, footers, forms, adverts, comments and the like are left out
       (:func:`_left_out`). If at least ``COMMON`` of a host's pages have an article or main element, only
       its slots count on those. What the other slots hold is decoded and cut to blocks.

    Null html gives empty text; null ids and urls are carried; repeated rows are kept, and
    each gets its text. Long and deep pages are read whole. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "template")
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    large = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where((F.col("pages") >= HOST_PAGES) & (F.col("host") != ""))
    large = sized(scratch.write(large, "hosts"), 64)
    rows = rows.join(large.select("host", F.lit(True).alias("own")), "host", "left").select(
        "page_id", "url", "html", F.when(F.col("own"), F.col("host")).otherwise(F.lit("")).alias("host")
    )

    def tokens(batches):
        names = ["host", "page", "token", "n", "place", "is_text", "out", "main", "chars"]
        for batch in batches:
            found = []
            for group, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number = _hash(page or "")
                found += [(group, number, *x) for x in page_tokens(page)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names)

    schema = "host string, page long, token long, n long, place double, is_text boolean, out boolean, main boolean, chars long"
    counted = bounded(rows.where("host <> ''").select("host", "html")).mapInArrow(tidy(tokens), schema).groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).cast("string").alias("vector"),
        F.count(F.lit(1)).alias("n"),
        F.max("n").alias("most"),
        F.avg("place").alias("place"),
        F.max("is_text").alias("is_text"),
        (F.avg(F.col("out").cast("double")) >= 0.5).alias("out"),
        F.max("main").alias("main"),
        F.sum("chars").alias("chars"),
    )
    counted = scratch.write(counted.where("n > 1 OR token = 0"), "tokens")
    groups = counted.where("token = 0").select("host", F.col("n").alias("pages"), F.col("chars").alias("total"))
    frequent = counted.where("token <> 0").join(sized(groups, 64), "host").where(F.col("n") >= F.col("pages") * SUPPORT)

    def deduce(group: pd.DataFrame) -> pd.DataFrame:
        t = nested_template(group)
        inner = t[~t["is_text"]]
        row = {
            "host": group["host"].iloc[0],
            "tokens": inner["token"].tolist(),
            "keeps": (~inner["out"].astype(bool)).tolist(),
            "texts": t[t["is_text"]]["token"].tolist(),
            "main_only": bool((inner["main"] & (inner["n"] >= inner["pages"] * COMMON)).any()),
            "main_slot": main_slot(t),
        }
        return pd.DataFrame([row])

    schema = "host string, tokens array<long>, keeps array<boolean>, texts array<long>, main_only boolean, main_slot long"
    templates = scratch.write(frequent.groupBy("host").applyInPandas(deduce, schema), "templates")
    held = templates.agg(F.sum(17 * F.size("tokens") + 8 * F.size("texts") + 64)).first()[0] or 0
    templates = F.broadcast(templates) if held <= BROADCAST_BYTES else templates
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "tokens", "keeps", "texts", "main_only", "main_slot")

    def run(batches):
        for batch in batches:
            last, slots, texts, out = None, {}, set(), []
            columns = [batch.column(i) for i in range(2, 8)]
            for i in range(batch.num_rows):
                key = columns[1][i]
                if last is None or not key.equals(last):
                    last = key
                    slots = dict(zip(key.as_py() or [], columns[2][i].as_py() or [], strict=True))
                    texts = set(columns[3][i].as_py() or [])
                out.append(extract(columns[0][i].as_py(), slots, texts, bool(columns[4][i].as_py()), columns[5][i].as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = dict(rows.dtypes)["page_id"]
    return bounded(joined).mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars long")
