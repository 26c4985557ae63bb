"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text right below them. A container is
named by its path of tags and classes without digits; the pages of a host vote
for all their paths with their scores. A page's root is the container under the
path with the most votes of its host, of those that hold enough of the page.

What is left out is judged to be menus, headers, footers, adverts, forms,
comments and the like; all other blocks are the text. Tags decide that; names
lower a container's vote, and leave it out only if they say clearly what it is, or
its links or its brevity bear them out, and never the root, nor all that a page
holds. Outside the root a container of links is a menu. Siblings that each name
an author and a date are comments.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.storage import written

#: Elements whose content is no text, elements that hold others, and elements that don't end a block.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|button|datalist|title|object|canvas|math"
CONTAINERS = frozenset("html head body div article section main nav header footer aside form ul ol dl table tbody tr td th figure fieldset details dialog menu center".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags and class or id words of what isn't the article, and class or id words of what is.
NOT_TEXT = frozenset("head nav header footer aside form menu dialog fieldset".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent conversation conversations cookie cookies discussion discussions disqus disclaimer feedback footer form header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies reply response responses reviews share sharing sidebar signup social sponsor sponsored subscribe tags talkback teaser thread threads toolbar widget widgets".split()
)
#: Words that are bad in the middle of a name too, words that only say what kind of box a name is for, and roles of what isn't the article.
CLEAR_WORDS = frozenset("advert advertisement breadcrumb breadcrumbs comment comments conversation conversations cookie cookies discussion discussions disqus feedback footer nav navbar navigation newsletter promo replies responses reviews sponsored subscribe talkback thread threads".split())
BOX_WORDS = frozenset("area bar block body bottom box btn button buttons col column container content count entry grid group holder icons inner item items left link links list main outer panel post posts region right row section site slot text title top tree unit user wrap wrapper zone".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of a class name that speak of a page's state, tags that no name makes bad, tags without an end.
STATES = frozenset("has have no not with without is js show hide hides open closed enabled disabled".split())
WRAPPERS = frozenset("html body article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of an article that are never its root; the share of a page's text that a root or a host path must hold.
PARTS = frozenset("ul ol dl table tbody tr td th section figure center details".split())
ENOUGH = 0.5
#: A name that could mean something else counts where links are this share of the text, or it has fewer characters; what is left of a page must be this share, or names are wrong there; a container of links.
LINKED, BRIEF, LEFT, MENU = 0.3, 200, 0.1, 0.5
#: Levels above a text to which its vote goes: a half each, so that what is beyond doesn't count.
LEVELS = 40
GOOD_WORDS = frozenset("article body content entry main post prose story text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + RAW + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>\"'<])*|[^><]*)>",
    re.S | re.I,
)
NAMES = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLES = re.compile(r"(?<![\w-])role\s*=\s*[\"']?\s*([a-z]+)", re.I)
CLASSES = re.compile(r"(?<![\w-])class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
AUTHOR, DATE = re.compile(r"\b(?:author|byline|user|username|nick|nickname|avatar|commenter)\b", re.I), re.compile(r"\b(?:date|datetime|time|timestamp|posted|ago)\b", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def bad_names(attributes: str) -> int:
    """How clearly names speak of boilerplate: 2, 1 if they could mean something else, 0 if they don't.

    A name with bad words alone, or with bad words and words for boxes, is clear; so
    are a bad role and a clear word at the end of a name. Another one is not if a bad
    word begins or ends it or a clear one stands in it. Names that speak of a state say
    nothing, camelBack parts are words, and a name of articles makes others doubtful.
    """
    worst, good = 0, False
    for name in " ".join("".join(m) for m in NAMES.findall(attributes)).split():
        parts = [part.lower() for part in PART.findall(name)]
        if not parts or STATES.intersection(parts):
            continue
        bad = [part in BAD_WORDS for part in parts]
        good |= not any(bad) and bool(GOOD_WORDS.intersection(parts))
        if "".join(parts) in BAD_WORDS or any(bad) and all(b or part in BOX_WORDS for b, part in zip(bad, parts)) or parts[-1] in CLEAR_WORDS:
            worst = 2
        elif bad[0] or bad[-1] or CLEAR_WORDS.intersection(parts):
            worst = max(worst, 1)
    if any(role.lower() in BAD_ROLES for role in ROLES.findall(attributes)):
        return 2
    return min(worst, 1) if good else worst


class Container:
    """An element that holds text: its own name, its parent's index, whether it is boilerplate by its tag or (1 or 2) by its names, the characters right in it and those in links, and whether it names an author or a date.

    `bad` says in the end whether it is boilerplate, also by what is above it.
    """

    __slots__ = ("own", "above", "parent", "bad", "named", "good", "chars", "links", "tag", "marks")

    def __init__(self, tag: str, attributes: str, parent: int, above: Container | None):
        words = set(WORD.findall(" ".join("".join(m) for m in NAMES.findall(attributes)).lower())) if attributes else set()
        classes = " ".join("".join(m) for m in CLASSES.findall(attributes)).lower() if attributes else ""
        names = sorted({re.sub(r"\d+", "", name) for name in classes.split()})
        self.own = ".".join([tag, *filter(None, names)])
        self.above, self.parent, self.tag = above, parent, tag
        self.bad = tag in NOT_TEXT
        self.named = bad_names(attributes) if attributes and tag not in WRAPPERS else 0
        self.good = tag in ("article", "main") or bool(words & GOOD_WORDS)
        self.chars = self.links = self.marks = 0

    @property
    def path(self) -> str:
        """The names from the page down, written out only for those that are asked: a page may be very deep."""
        names, c = [], self
        while c is not None:
            names.append(c.own)
            c = c.above
        return ">".join(reversed(names))


def parse(page: str) -> tuple[list[Container], list[tuple[int, str]]]:
    """(containers, blocks): a block is (container index, text) in page order."""
    root = Container("page", "", -1, None)
    found, blocks = [root], []
    stack = [0]
    text: list[str] = []
    link = at = 0

    def flush():
        if text:
            joined = " ".join(html_module.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((stack[-1], joined))
                found[stack[-1]].chars += len(joined)

    def add(piece):
        if piece:
            text.append(piece)
            if link:
                found[stack[-1]].links += len(piece)

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), m[2]
        if not closing and (tag == "time" or m[4]):
            found[stack[-1]].marks |= 2 * (tag == "time" or bool(DATE.search(m[4]))) + bool(AUTHOR.search(m[4]))
        if tag == "a":
            link = 0 if closing else 1
        top = found[stack[-1]].tag
        if tag in INLINE:
            # Other elements are held only if their names make them boilerplate.
            if closing and top == tag or not closing and tag not in VOID and (top == tag or m[4] and bad_names(m[4])):
                flush()
                if closing:
                    stack.pop()
                else:
                    found.append(Container(tag, m[4], stack[-1], found[stack[-1]]))
                    stack.append(len(found) - 1)
            continue
        flush()
        # Those without an end stop at the next block, items at the next item.
        while tag not in VOID and (top in INLINE or top == "p") or not closing and top == tag and tag not in CONTAINERS:
            stack.pop()
            top = found[stack[-1]].tag
        if tag not in CONTAINERS and (tag in VOID or not closing and not (m[4] and bad_names(m[4]))):
            continue
        link = 0
        if not closing:
            if not m[4].endswith("/"):
                found.append(Container(tag, m[4], stack[-1], found[stack[-1]]))
                stack.append(len(found) - 1)
            continue
        for depth in range(len(stack) - 1, 0, -1):
            held = found[stack[depth]].tag
            if held == tag:
                del stack[depth:]
                break
            if tag not in CONTAINERS and held in ("ul", "ol", "dl", "table"):
                break
    add(page[at:])
    flush()
    for c in found:  # what holds the main element, or a form with an article, is no boilerplate
        # What is above one of these was cleared with it: as far as both clear the same, the way up ends there.
        if c.tag in ("article", "main"):
            k, main = c.parent, c.tag == "main"
            while k >= 0 and not (found[k].good and found[k].tag in ("article", "main") and (not main or found[k].tag == "main")):
                found[k].bad &= not main and found[k].tag != "form"
                found[k].named = 0 if main else found[k].named
                k = found[k].parent
    judge(found)
    return found, blocks


def sums(found: list[Container], of) -> list[int]:
    """What `of` says of each container and all in it."""
    out = [of(c) for c in found]
    for i in range(len(found) - 1, 0, -1):  # parents come first
        out[found[i].parent] += out[i]
    return out


def comments(found: list[Container]) -> set[int]:
    """Siblings of one name that each hold an author and a date, and text."""
    marks, groups = [c.marks for c in found], {}
    for i in range(len(found) - 1, 0, -1):
        marks[found[i].parent] |= marks[i]
    for i, c in enumerate(found):
        if c.parent >= 0 and c.tag not in ("article", "main", "table", "tr", "td", "tbody") and marks[i] == 3:
            groups.setdefault((c.parent, c.own), []).append(i)
    return {i for own in groups.values() if len(own) > 1 for i in own}


def judge(found: list[Container]) -> None:
    """Settle what is boilerplate: tags first, then names and comments as far as they leave enough of the page.

    If they don't, those are wrong that hold most of the page, then doubtful ones, then all.
    """
    by_tag = [c.bad for c in found]
    for i, c in enumerate(found):
        by_tag[i] = c.bad or (c.parent >= 0 and by_tag[c.parent])
    for i, c in enumerate(found):
        c.bad = by_tag[i]
    chars, links = sums(found, lambda c: 0 if c.bad else c.chars), sums(found, lambda c: 0 if c.bad else c.links)
    talk = comments(found)
    level = [2 if i in talk else 0 if c.named == 1 and not (links[i] >= LINKED * chars[i] or chars[i] < BRIEF) else c.named for i, c in enumerate(found)]
    tries = (lambda i: level[i] > 0, lambda i: level[i] > 0 and chars[i] < ENOUGH * chars[0], lambda i: level[i] > 1 and chars[i] < ENOUGH * chars[0], lambda i: False)
    body = [False] * len(found)  # in an article, or in what is named as one
    for i, c in enumerate(found):
        body[i] = c.good and c.tag not in ("page", "html", "body") or (c.parent >= 0 and body[c.parent])
    for bad in tries:
        out, left, sure = [False] * len(found), 0, False
        for i, c in enumerate(found):
            out[i] = by_tag[i] or bad(i) or (c.parent >= 0 and out[c.parent])
            left += 0 if out[i] else c.chars
            sure |= not out[i] and body[i] and c.chars > 0
        if sure or left >= LEFT * chars[0] and (left or not chars[0]):
            break
    for i, c in enumerate(found):
        c.bad = out[i]


def scores(containers: list[Container]) -> dict[int, float]:
    """The score of each container that can be a root."""
    score: dict[int, float] = {}
    for i, c in enumerate(containers):
        if c.bad:
            continue
        own, weight, k, level = max(0, c.chars - 2 * c.links), 1.0, i, 0
        while k >= 0 and own and level < LEVELS:  # what is above a container gets half of it, a quarter, and so on; parts give all of theirs
            if containers[k].tag not in PARTS:
                score[k] = score.get(k, 0.0) + own * weight
                weight /= 2
                level += 1
            k = containers[k].parent
    return {k: s * (1.5 if containers[k].good else 1.0) / (1 + containers[k].named) for k, s in score.items() if s > 0}


def path_ids(containers: list[Container]) -> list[int]:
    """64 bits for the path of each container."""
    out: list[int] = []
    for c in containers:
        out.append(_extended(out[c.parent] if c.parent >= 0 else 0, c.own))
    return out


def _extended(above: int, own: str) -> int:
    return int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8, key=above.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def path_id(path: str) -> int:
    """The id of a written path."""
    out = 0
    for own in path.split(">"):
        out = _extended(out, own)
    return out


def shares(found: dict[int, float], paths: list) -> dict:
    """The scores of containers by their paths, as a share of the best one."""
    out: dict = {}
    for k, s in sorted(found.items()):
        out[paths[k]] = out.get(paths[k], 0.0) + s
    best = max(out.values(), default=0.0)
    return {path: s / best for path, s in out.items()}


def votes(containers: list[Container]) -> dict[str, float]:
    """The votes of a page by its written paths."""
    found = scores(containers)
    return shares(found, {k: containers[k].path for k in found})


def vote_ids(page: str) -> dict[int, float]:
    """The votes of a page by the ids of its paths."""
    containers = parse(page)[0]
    return shares(scores(containers), path_ids(containers))


def article(page: str, paths: list[str] | dict[int, int]) -> str:
    """All blocks that aren't boilerplate, in page order.

    The root are the containers under the first of `paths`, or the one with the
    most votes by path id, that holds enough of the page, or else under its own
    best path. Where the one main element holds enough, what is outside it is not
    the article; outside the root's best container those of links are menus.
    """
    containers, blocks = parse(page)
    held = sums(containers, lambda c: 0 if c.bad else max(0, c.chars - 2 * c.links))
    found, ids = scores(containers), path_ids(containers)
    own = shares(found, ids)
    at: dict[int, list[int]] = {}
    for i in found:
        at.setdefault(ids[i], []).append(i)

    def below(roots) -> list[bool]:
        inside = [False] * len(containers)
        for i, c in enumerate(containers):
            inside[i] = not c.bad and (i in roots or (c.parent >= 0 and inside[c.parent]))
        return inside

    def enough(roots) -> bool:  # none of them holds another
        return sum(held[i] for i in roots) >= ENOUGH * held[0]

    if isinstance(paths, dict):
        ranked = sorted((p for p in own if paths.get(p)), key=lambda p: (-paths[p], p))
    else:
        ranked = [p for p in map(path_id, paths) if p in at]
    ranked += sorted(own, key=lambda p: (-own[p], p))[:1]
    roots = next((set(at[p]) for p in ranked if enough(at[p])), set(at[ranked[-1]]) if ranked else set())
    root = below(roots)
    best = max((p for p in sorted(own) if any(root[i] for i in at[p])), key=own.get, default=None)
    core = below({i for i in at.get(best, ()) if root[i]})  # a host's pages may agree on no more than what is around their articles
    mains = {i for i, c in enumerate(containers) if c.tag == "main" and not c.bad}
    in_main = below(mains)
    outer = [i for i in mains if not in_main[containers[i].parent]]
    within = in_main if len(outer) == 1 and enough(outer) else below({0})
    chars, links = sums(containers, lambda c: 0 if c.bad else c.chars), sums(containers, lambda c: 0 if c.bad else c.links)
    holds = [False] * len(containers)  # in the core or above it
    for i in range(len(containers) - 1, -1, -1):
        holds[i] |= core[i]
        if holds[i] and i:
            holds[containers[i].parent] = True
    menu = [False] * len(containers)
    for i, c in enumerate(containers):
        menu[i] = not holds[i] and (links[i] > MENU * chars[i] or (c.parent >= 0 and menu[c.parent]))
    return " ".join(text for i, text in blocks if within[i] and not menu[i])


def host_of(url: F.Column) -> F.Column:
    """The lower-cased host of a URL; empty for null or without `://`."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def extract_articles(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Takes page_id, url and html; further columns are ignored. Null or empty
    html, and a page without text outside boilerplate, give an empty text. Pages
    with a null url, or without a host, vote together. Repeated rows vote
    repeatedly and give repeated results; an empty table gives none. Texts are
    whole. Ties between paths go to the smaller id. All votes of
    all hosts go to the executors if they take up to `broadcast_bytes`;
    otherwise each page's own paths meet their votes in a join by host and path.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))

    def vote(batches):
        for batch in batches:
            total: dict[tuple[str, int], float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, share in vote_ids(page.as_py() or "").items():
                    key = host, path
                    total[key] = total.get(key, 0.0) + share
            rows = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([round(total[r] * 1e6) for r in rows], pa.int64())], names=["host", "path", "votes"])

    counted = written(base.select("host", "html").mapInArrow(vote, "host string, path long, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes")), "host-paths", narrow=True)
    size = counted.agg(F.sum(F.octet_length("host") + 24)).first()[0] or 0
    out = "page_id long, url string, text string"
    if size <= broadcast_bytes:
        known: dict[str, dict[int, int]] = {}
        for r in counted.toLocalIterator():
            known.setdefault(r.host, {})[r.path] = r.votes
        sent = pages.sparkSession.sparkContext.broadcast(known)

        def extract(batches):
            for batch in batches:
                texts = [article(page.as_py() or "", sent.value.get(host, {})) for page, host in zip(batch.column(2), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        return base.mapInArrow(extract, out).withColumn("n_chars", F.length("text").cast("long"))

    # Pages of one host and html have one result; they are named by two hashes.
    named = base.withColumns({"h1": F.xxhash64("host", F.coalesce("html", F.lit(""))), "h2": F.xxhash64(F.coalesce("html", F.lit("")), "host")})

    def own_paths(batches):
        for batch in batches:
            rows = [(h1, h2, host, p) for h1, h2, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)) for p in vote_ids(page.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["h1", "h2", "host", "path"])

    asked = named.select("h1", "h2", "host", "html").mapInArrow(own_paths, "h1 long, h2 long, host string, path long").distinct()
    told = asked.join(counted, ["host", "path"]).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("path", "votes"))).alias("known"))

    def extract_told(batches):
        for batch in batches:
            texts = [article(page.as_py() or "", dict(known or ())) for page, known in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return named.join(told, ["h1", "h2"], "left").select("page_id", "url", "html", "known").mapInArrow(extract_told, out).withColumn("n_chars", F.length("text").cast("long"))
