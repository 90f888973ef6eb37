"""Main text of web pages: a bidirectional LSTM in numpy labels every block from its tags, its words and the whole page.

No page comes with labels.  The network is trained on pages whose blocks stand inside elements that say what they are
(article, nav, footer and so on), and on the same pages with these names taken away or the page rebuilt from divs, so that
it also has to go by words, lengths, links and order.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.langid import smallest

SAMPLE = 600  # pages to train on
PATHS, TERMS, NUMBERS = 64, 64, 10  # hashed tag-path features, hashed words, and plain measures of a block
MISNAMED = 0.15  # share of the names in rebuilt training pages that say the opposite
HIDDEN = 24
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script|\Z)|<style\b.*?(?:</style|\Z)|"
                     r"<(/?)(noscript|template|iframe|object|canvas|annotation-xml)(?![\w:-])", re.S | re.I)
# fixed lists of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
                 "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
                          "span strike strong sub sup time tt u var wbr img".split())
SILENT = frozenset("script style noscript template svg iframe object canvas head title textarea select annotation annotation-xml".split())
IN_HEAD = frozenset("head title meta link base basefont bgsound style script noscript template noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                  "h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDS_BLOCKS = frozenset("noscript template iframe object canvas annotation-xml".split())  # silent, and hold blocks if they are closed at all
INTO_HTML = frozenset("foreignobject desc title".split())  # elements of svg that hold blocks
RAW = frozenset("script style textarea title".split())  # hold no tags
CLOSED_BY_BLOCK = "p"
CLOSES_SELF = frozenset("li dt dd option tr td th".split())
# fixed lists: element and attribute names by which an author says what a block is
SAYS_MAIN = frozenset("article main content post entry story body".split())
SAYS_OTHER = frozenset("nav menu header footer aside sidebar side ad ads advert advertisement banner promo sponsor sponsored cookie consent notice "
                       "comment comments reply form newsletter subscribe login search related share social breadcrumb breadcrumbs "
                       "pagination pager toolbar widget popup modal alert copyright navigation contentinfo complementary".split())
NOT_OF_IT = frozenset("has have no not non with without hide hidden show is in".split())  # has-sidebar doesn't name a sidebar


@dataclass
class Block:
    text: str
    path: tuple  # tag names and attribute words from the outside in
    linked: int  # characters inside links


def _names(attributes: str) -> tuple:
    """Words of class, id and role; a compound like ``has-sidebar`` is one word of its own, which is in no list."""
    out = []
    for a in _ATTRIBUTE.finditer(attributes):
        for value in (a[2] or a[3] or a[4] or "").lower().split():
            words = _NAME.findall(value)
            out += words if NOT_OF_IT.isdisjoint(words[:-1]) else ["-".join(words)]
    return tuple(out)


def _closed(page: str) -> set[int]:
    """Where the elements of HOLDS_BLOCKS begin that have an end tag of their own."""
    opened: dict[str, list[int]] = {}
    out = set()
    for m in _HIDDEN.finditer(page):
        if m[2]:
            places = opened.setdefault(m[2].lower(), [])
            if not m[1]:
                places.append(m.start())
            elif places:
                out.add(places.pop())
    return out


def blocks(page: str | None) -> list[Block]:
    """Text between block elements in page order, with character references decoded and white space folded.

    Inline elements, formulas and line breaks inside a block are no borders; scripts, styles, comments and other markup give nothing.
    A paragraph ends where a block begins, whether it was closed or not.  The head ends at the first text or element that cannot
    stand in it, and an element that hides its text ends where its parent does or a block begins that it cannot hold.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "silent": 0}
    whole: list[bool] = []  # for each open element, whether it hides blocks up to an end tag of its own
    closed: set[int] | None = None

    def flush():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, tuple(x for tag, names in stack if tag not in INLINE for x in (tag, *names)), state["linked"]))
        parts.clear()
        state["linked"] = 0

    def say(raw: str):
        if state["silent"] and stack[-1][0] == "head" and not raw.isspace() and raw:
            leave(len(stack) - 1)
        if raw and not state["silent"]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["links"]:
                state["linked"] += len(_SPACE.sub(" ", text))

    def leave(depth: int):
        for tag, _ in stack[depth:]:
            state["links"] -= tag == "a"
            state["silent"] -= tag in SILENT
        del stack[depth:], whole[depth:]

    def unhide(name: str):
        """Leave the outermost silent element that cannot hold the element ``name``."""
        for i, (tag, _) in enumerate(stack):
            if whole[i]:
                return
            if tag == "head":
                out = name not in IN_HEAD and not any(whole[i:])
            elif tag == "select":
                out = name in BLOCK or name in ("select", "input", "textarea")
            elif tag == "svg":
                out = name in BLOCK and not any(t in INTO_HTML for t, _ in stack[i:])
            else:
                out = tag in SILENT and name in BLOCK
            if out:
                leave(i)
                return

    at, skip = 0, None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        closing, name = m[1], (m[2] or "").lower()
        say(page[at:m.start()])
        at = m.end()
        if not name:
            continue
        if closing:
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in INLINE and name not in VOID:
                flush()
            if opened is not None:
                leave(opened)
            continue
        if state["silent"]:
            unhide(name)
        if name in VOID:
            if name in ("br", "wbr", "img", "input"):
                parts.append(" " if name != "wbr" else "")
            elif name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == CLOSED_BY_BLOCK:
                    leave(i)
                    break
                if name in CLOSES_SELF and stack[i][0] == name:
                    leave(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        names = _names(m[3]) if m[3] and name not in ("html", "body") else ()  # those of the page aren't said of a block
        if (m[3] or "").rstrip().endswith("/") and (name not in INLINE or name in MATH):
            continue
        if name in HOLDS_BLOCKS and closed is None:
            closed = _closed(page)
        stack.append((name, names))
        whole.append(name in HOLDS_BLOCKS and m.start() in closed)
        state["links"] += name == "a"
        state["silent"] += name in SILENT
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            say(page[at:stop])
            at = end.end() if end else len(page)
            leave(len(stack) - 1)
    say(page[at:])
    flush()
    return out


def told(block: Block) -> int | None:
    """1 or 0 if the elements around a block say that it is main text or not; the innermost word counts.

    A label to train on and an input of the network, which alone decides.
    """
    return _of_path(block.path)[1]


@lru_cache(50_000)
def _of_path(path: tuple) -> tuple[list, int | None]:
    """Hashed places of a path's words, and what the innermost telling word says."""
    said = next((int(word in SAYS_MAIN) for word in reversed(path) if word in SAYS_OTHER or word in SAYS_MAIN and word != "body"), None)
    return sorted({zlib.crc32(word.encode()) % PATHS for word in path}), said


class _Slots(dict):
    """Hashed place of a word; looked up once for a word, and forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = place = zlib.crc32(word.encode("utf-8", "replace")) % TERMS
        return place


_SLOTS = _Slots()


def vectors(page: list[Block]) -> np.ndarray:
    """Hashed tag paths and words, and measures of length, links, marks and place."""
    out = np.zeros((len(page), PATHS + TERMS + NUMBERS), np.float32)
    for i, b in enumerate(page):
        places, said = _of_path(b.path)
        out[i, places] = 1.0
        terms = b.text.lower().split(" ")
        out[i, PATHS:PATHS + TERMS] = np.bincount([_SLOTS[word] for word in terms], minlength=TERMS)
        size = len(b.text)
        out[i, PATHS:PATHS + TERMS] /= np.sqrt(len(terms)) * 4
        out[i, -NUMBERS:] = (np.log1p(size) / 8, np.log1p(len(terms)) / 6, min(1.0, b.linked / size), b.text[-1] in ".!?:;\"'”»",
                             sum(c in ".,;" for c in b.text) / size * 10, i / len(page), 1 / (1 + i), 1 / (len(page) - i),
                             said == 1, said == 0)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of a page, and a logistic output on both states."""

    def __init__(self, n_in: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(n_in)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, scale, (n_in, 4 * hidden))
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p["c" + d] = np.zeros(4 * hidden)
            self.p["c" + d][hidden:2 * hidden] = 1.0
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden)
        self.p["c"] = np.zeros(1)
        self.hidden = hidden
        self.trained = False

    def _pass(self, x, mask, d, keep):
        """One direction over (pages, blocks, features); states stay put where the mask is 0."""
        n, steps, k = len(x), x.shape[1], self.hidden
        h, c = np.zeros((n, k)), np.zeros((n, k))
        states = np.zeros((n, steps, k))
        kept = []
        given = x @ self.p["w" + d] + self.p["c" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.p["u" + d]
            i, f, o = _sigmoid(z[:, :k]), _sigmoid(z[:, k:2 * k]), _sigmoid(z[:, 2 * k:3 * k])
            g = np.tanh(z[:, 3 * k:])
            m = mask[:, t, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c_new)
            h_new = m * o * tc + (1 - m) * h
            if keep:
                kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            states[:, t] = h
        return states, kept

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["c"])

    def gradients(self, x, mask, y, known):
        """Gradients of the mean log loss over the known blocks."""
        k = self.hidden
        runs = {d: self._pass(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid(both @ self.p["o"] + self.p["c"])
        delta = (p - y) * known / max(known.sum(), 1)
        g = {"o": np.einsum("ns,nsk->k", delta, both), "c": np.array([delta.sum()])}
        for j, d in enumerate("fb"):
            out = delta[:, :, None] * self.p["o"][j * k:(j + 1) * k]
            gw, gu, gc = np.zeros_like(self.p["w" + d]), np.zeros_like(self.p["u" + d]), np.zeros_like(self.p["c" + d])
            dh, dc = np.zeros((len(x), k)), np.zeros((len(x), k))
            for t, h, c, i, f, o, cand, tc, m in reversed(runs[d][1]):
                dh = dh + out[:, t]
                into = m * dh
                dct = m * (dc + into * o * (1 - tc * tc))
                dz = np.concatenate([dct * cand * i * (1 - i), dct * c * f * (1 - f), into * tc * o * (1 - o), dct * i * (1 - cand * cand)], axis=1)
                gw += x[:, t].T @ dz
                gu += h.T @ dz
                gc += dz.sum(0)
                dh = (1 - m) * dh + dz @ self.p["u" + d].T
                dc = dct * f + (1 - m) * dc
            g["w" + d], g["u" + d], g["c" + d] = gw, gu, gc
        return g

    def fit(self, pages: list, rounds: int = 12, batch: int = 32, rate: float = 0.01) -> "Labeller":
        """Adam over batches of (vectors, labels, known) pages of similar length; the weights are the mean of the last rounds' ones."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step = np.random.default_rng(11), 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        mean, last = {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for turn in range(rounds):
            for j in rng.permutation(len(groups)):
                x, mask = pad([pages[i][0] for i in groups[j]])
                y, known = np.zeros(mask.shape), np.zeros(mask.shape)
                for r, i in enumerate(groups[j]):
                    y[r, :len(pages[i][1])], known[r, :len(pages[i][2])] = pages[i][1], pages[i][2]
                step += 1
                for k, g in self.gradients(x, mask, y, known).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                if 3 * turn >= 2 * rounds:
                    mean, last = {k: mean[k] + v for k, v in self.p.items()}, last + 1
        self.p = {k: v / last for k, v in mean.items()} if last else self.p
        self.trained = True
        return self


def pad(xs: list) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(x) for x in xs)
    out, mask = np.zeros((len(xs), longest, xs[0].shape[1])), np.zeros((len(xs), longest))
    for i, x in enumerate(xs):
        out[i, :len(x)], mask[i, :len(x)] = x, 1
    return out, mask


def _retold(page: list[Block], labels: list, rng) -> list[Block]:
    """The same page with other markup: names taken away, or given by classes of divs, some of which mislead."""
    kind = rng.integers(0, 3)
    if kind == 0:
        return page
    main, other = sorted(SAYS_MAIN - {"body"}), sorted(SAYS_OTHER)
    main_name, out = main[rng.integers(len(main))], []
    for b, label in zip(page, labels):
        last = b.path[-1] if b.path and b.path[-1] not in SAYS_MAIN | SAYS_OTHER else "p"
        said = label if rng.random() >= MISNAMED else 1 - label
        name = () if kind == 1 and rng.random() < 0.7 else (main_name if said == 1 else other[rng.integers(len(other))],)
        out.append(Block(b.text, ("html", "body", "div", *name, last), b.linked))
    return out


def training_pages(raw: list, seed: int = 3) -> list:
    """(vectors, labels, known) of pages, as they are, and rebuilt with notices, forms and reader comments; few pages more than once."""
    rng, out, copies = np.random.default_rng(seed), [], min(8, max(1, SAMPLE // max(len(raw), 1)))
    parsed = [blocks(h) for h in raw]
    texts = [b.text for page in parsed for b in page if told(b) == 1] or ["text"]
    for page in parsed:
        labels = [told(b) for b in page]
        if not page or not any(v is not None for v in labels):
            continue
        known = np.array([v is not None for v in labels], float)
        y = np.array([v or 0 for v in labels], float)
        out.append((vectors(page), y, known))
        for _ in range(copies):
            # the last known blocks get company that is no main text although it reads like it
            more, marks = list(page), list(labels)
            for name in rng.permutation(["comments", "aside", "form", "cookie", "header", "related"])[:2]:
                text = texts[rng.integers(len(texts))]
                block = Block(text[:int(rng.integers(20, 300))].strip() or "text", ("html", "body", "div", str(name), "p"), 0)
                place = int(rng.integers(len(more) + 1)) if name in ("form", "cookie") else (len(more) if name != "header" else 0)
                more.insert(place, block)
                marks.insert(place, 0)
            # main text is not only long paragraphs: some blocks turn into short ones, list items, headings, cells, quotations
            for i in np.flatnonzero(rng.random(len(more)) < 0.4):
                if marks[i] == 1:
                    outer = more[i].path[:-1] if len(more[i].path) > 1 else more[i].path
                    kind = [("ul", "li"), ("ol", "li"), ("h2",), ("h3",), ("blockquote",), ("table", "tr", "td"), ("dl", "dd"), ("pre",), ("p",), ("p",), ("p",)][rng.integers(11)]
                    text = more[i].text[:int(rng.integers(1, 80))].strip() or "a"
                    more[i] = Block(text, (*outer, *kind), len(text) if rng.random() < 0.1 else 0)
            # and not every page begins with links and ends with a footer
            if rng.random() < 0.5:
                a, b = sorted(rng.integers(0, len(more) + 1, 2))
                more, marks = (more[a:b], marks[a:b]) if a < b else (more, marks)
            sure = [0 if v is None else v for v in marks]
            out.append((vectors(_retold(more, sure, rng)), np.array(sure, float), np.array([v is not None for v in marks], float)))
    return out


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """Train on the ``sample`` pages whose ids have the smallest hashes.

    Where no such page has a block whose names tell what it is, as in an empty table, there is nothing to learn from: the
    labeller stays untrained, and ``main_text`` then keeps every block.
    """
    rows = pages.filter(F.col(html_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("draw", F.xxhash64("id"))
    picked = smallest(rows.withColumn("all", F.lit(1)), "all", F.col("draw"), sample)
    near = rows.filter(F.col("draw") <= picked["1"]) if picked else rows.limit(0)  # so no task sends more than its part of the sample
    raw = [r["html"] for r in near.orderBy("draw", "id", "html").limit(sample).collect()]
    model = Labeller(PATHS + TERMS + NUMBERS)
    examples = training_pages(raw)
    return model.fit(examples) if examples else model


def main_text(pages: list, model: Labeller, batch: int = 256, steps: int = 2000) -> list[str]:
    """Main text of each page: the blocks that the network takes for it, joined by empty lines.

    Names in the markup are inputs of the network and decide nothing by themselves.  An untrained network decides nothing
    either: all blocks are main text.  Pages are labelled in batches of similar length; a page of more than ``steps`` blocks is read in windows that overlap by half.
    """
    parsed = [blocks(h) for h in pages]
    if not model.trained:
        return ["\n\n".join(b.text for b in page) for page in parsed]
    scores = [np.zeros(len(p)) for p in parsed]
    jobs = []
    for i, page in enumerate(parsed):
        x = vectors(page) if page else None
        for a in range(0, max(len(page) - steps // 2, min(len(page), 1)), steps // 2):
            jobs.append((i, a, x[a:a + steps]))
    jobs.sort(key=lambda j: len(j[2]))
    first = 0
    while first < len(jobs):
        size = max(1, min(batch, 20_000 // len(jobs[min(first + batch, len(jobs)) - 1][2])))
        group = jobs[first:first + size]
        p = model.predict(*pad([x for _, _, x in group]))
        for r, (i, a, x) in enumerate(group):
            lead = 0 if a == 0 else steps // 4
            scores[i][a + lead:a + len(x)] = p[r, lead:len(x)]
        first += size
    out = []
    for page, p in zip(parsed, scores):
        out.append("\n\n".join(b.text for b, v in zip(page, p) if v > 0.5))
    return out


def extract_main_text(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars``; input columns of these names are replaced.

    A null or empty page, or one without main text, has an empty text.
    """
    inputs = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("string")
    def extract(page: pd.Series) -> pd.Series:
        out, raw = [], page.tolist()
        for a in range(0, len(raw), 512):
            out += main_text(raw[a:a + 512], shared.value)
        return pd.Series(out, dtype=object)

    out = pages.select(*[F.col(f"`{c}`") for c in inputs], extract(F.col(f"`{html_col}`").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
