"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read tag by tag into leaf blocks, runs of text between two block boundaries, each with its open elements.
Features are the ancestors' tags and the words of their classes, ids and roles, the block's text, and its place in the
page. The field labels all blocks of a page together: it is trained by conditional likelihood on labelled pages and
decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bound of the training sample: labelled pages.
SAMPLE_PAGES = 1_000
#: Paths whose score a task keeps at hand.
KEPT_PATHS = 50_000
#: Starts the text of a main block in a labelled page.
MARK = "\ue000"

#: Fixed by the language of pages: elements that break a line of text, that stand alone, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes noscript xmp svg math select button object audio video canvas".split())
#: An opening tag ends these open elements, up to the nearest element that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold one piece of text; the one around them is a block's container.
PIECES = frozenset("p li dt dd td th tr tbody thead tfoot h1 h2 h3 h4 h5 h6 pre figcaption caption legend summary blockquote address ul ol dl table figure".split())

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<(?:[!?]|/(?=[^A-Za-z]))[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|itemprop)(?![^\s=/>])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(50_000)
def attribute_words(attributes: str) -> tuple[str, ...]:
    """The words of an element's class, id, role and itemprop, singular; "hidden" where it is not shown."""
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "style":
            if name == "hidden" or re.search(r"display\s*:\s*none", value, re.I):
                out.add("hidden")
            continue
        for w in WORD.findall(HUMP.sub(" ", value).lower()):
            out.add(w[:-1] if len(w) > 3 and w.endswith("s") else w)
    return tuple(sorted(out))


def leaf_blocks(html: str) -> list[tuple[tuple, str, int]]:
    """(open elements as (tag, words), text, characters inside links) for each leaf block with text, in page order."""
    out: list[tuple[tuple, str, int]] = []
    stack: list[tuple[str, tuple]] = []
    parts: list[str] = []
    linked = at = links = 0
    head = False
    opened: dict[str, int] = {}

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not head:
                path = stack if len(stack) <= 64 else stack[:16] + stack[-48:]
                out.append((tuple(path), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            links -= tag == "a"
            opened[tag] -= 1
        del stack[k:]

    size = len(html)
    while at < size:
        m = TAG.search(html, at)
        text = html[at : m.start() if m else size]
        if text and not head:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None or html[at - 1] != ">":  # a comment or declaration, or a tag that the end of the page cuts off
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "head":
                head = False
            if tag in BLOCKS:
                close()
            elif tag == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1) if opened.get(tag) else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:  # the end of an inline element does not end a block
                    break
                if stack[k][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag == "head":
            head = True
            continue
        if tag == "body":
            head = False
        if tag in RAW:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(html, at)
            at = end.end() if end else size
            parts.append(" ")
            continue
        if tag in BLOCKS:
            head = False
            close()
            for k in range(len(stack) - 1, -1, -1) if opened.get("p") else ():  # a block ends an open paragraph
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            if tag in ENDS:
                which, within = ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in which:
                        pop(k)
                        break
                    if stack[k][0] in within:
                        break
            elif tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                pop(len(stack) - 1)
        elif tag in ("br", "img"):
            parts.append(" ")
        if tag in VOID:
            continue
        if tag == "a":
            if links:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "a":
                        pop(k)
                        break
            links += 1
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, attribute_words(m[3]) if m[3] else ()))
    close()
    return out


@lru_cache(50_000)
def path_features(path: tuple) -> tuple[str, ...]:
    """Tags and attribute words of the open elements, and which tags hold the text."""
    tags = [t for t, _ in path if t in BLOCKS]
    out = {f"in:{t}" for t, _ in path} - {"in:html", "in:body"}
    last = tags[-1] if tags else "none"
    out |= {f"last:{last}", f"two:{tags[-2] if len(tags) > 1 else 'none'}>{last}"}
    home = next((t for t in reversed(tags) if t not in PIECES), "none")
    out |= {f"home:{home}", f"home:{home}>{last}"}
    main = max((k for k, (t, w) in enumerate(path) if t in ("article", "main")), default=-1)
    for k, (_, words) in enumerate(path):
        for w in words:
            out |= {f"word:{w}", f"part:{w[:4]}"}
            if 0 <= main < k:
                out.add(f"inside:{w}")
    if main >= 0 and not any(words for _, words in path[main + 1 :]) and all(t in PIECES or t not in BLOCKS for t, _ in path[main + 1 :]):
        out.add("plain-main")
    if main < 0:
        out.add("no-main")
    elif any(t in ("aside", "nav", "footer", "form", "section", "header") for t, _ in path[main + 1 :]):
        out |= {f"main>{t}" for t, _ in path[main + 1 :] if t in ("aside", "nav", "footer", "form", "section", "header")}
    return tuple(sorted(out))


def _container(path: tuple) -> tuple:
    k = len(path)
    while k and (path[k - 1][0] in PIECES or path[k - 1][0] not in BLOCKS):
        k -= 1
    return path[:k]


def place_features(blocks: list[tuple[tuple, str, int]]) -> list[list[str]]:
    """The names of each block's features of text and place; those of its path come beside them."""
    held: dict[tuple, int] = {}
    homes = [_container(path) for path, _, _ in blocks]
    for home, (_, text, linked) in zip(homes, blocks):
        held[home] = held.get(home, 0) + len(text) - linked
    whole, most = max(1, sum(held.values())), max(held.values(), default=0)
    out = []
    heading = False
    for i, (path, text, linked) in enumerate(blocks):
        n = len(text)
        size, link = n.bit_length(), min(3, 4 * linked // (n + 1))
        last = next((t for t, _ in reversed(path) if t in BLOCKS), "none")
        share = held[homes[i]] / whole
        heading = heading or last == "h1"
        names = [
            "bias",
            f"size:{size}",
            f"link:{link}",
            f"size-link:{min(size, 9)}:{link}",
            f"tag-size:{last}:{min(size, 9)}",
            f"end:{text[-1] if text[-1] in '.!?:;…»”' else 'none'}",
            f"commas:{min(3, text.count(','))}",
            f"share:{int(4 * share)}",
            f"most:{held[homes[i]] == most}",
            f"place:{5 * i // len(blocks)}",
            f"heading:{heading}",
            f"before:{i > 0 and homes[i - 1] == homes[i]}",
            f"after:{i + 1 < len(blocks) and homes[i + 1] == homes[i]}",
        ]
        if "©" in text:
            names.append("copyright")
        if "|" in text or "»" in text or "·" in text:
            names.append("bars")
        out.append(names)
    return out


def features(blocks: list[tuple[tuple, str, int]]) -> list[list[str]]:
    """The names of each block's features."""
    return [names + list(path_features(path)) for names, (path, _, _) in zip(place_features(blocks), blocks)]


class Field:
    """Weights of features for the main label, and scores of the four steps between labels (0 other, 1 main)."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]]):
        self.weights, self.steps = weights, steps
        self._paths: dict[tuple, float] = {}

    def emissions(self, blocks: list[tuple[tuple, str, int]]) -> list[float]:
        get, paths, out = self.weights.get, self._paths, []
        for names, (path, _, _) in zip(place_features(blocks), blocks):
            if path not in paths:
                if len(paths) > KEPT_PATHS:
                    paths.clear()
                paths[path] = math.fsum(get(name, 0.0) for name in path_features(path))
            out.append(paths[path] + math.fsum([get(name, 0.0) for name in names]))
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """The likeliest labels of all blocks together (Viterbi); ties go to 0."""
        (s00, s01), (s10, s11) = self.steps
        a = b = 0.0
        back = []
        for i, e in enumerate(scores):
            if i:
                to0, to1 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10), (0, a + s01) if a + s01 >= b + s11 else (1, b + s11)
                back.append((to0[0], to1[0]))
                a, b = to0[1], to1[1] + e
            else:
                b = e
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1] if scores else []

    def label(self, blocks: list[tuple[tuple, str, int]]) -> list[int]:
        return self.decode(self.emissions(blocks))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(emit: np.ndarray, steps: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels, and its gradients by emissions (of label 1) and steps; rows are padded pages."""
    pages, longest = emit.shape
    there = np.arange(longest)[None, :] < lengths[:, None]
    both = np.stack([np.zeros_like(emit), emit], 2)
    ahead, behind = np.zeros((pages, longest, 2)), np.zeros((pages, longest, 2))
    ahead[:, 0] = both[:, 0]
    for t in range(1, longest):
        now = _log_sum(ahead[:, t - 1, :, None] + steps[None], 1) + both[:, t]
        ahead[:, t] = np.where(there[:, t, None], now, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        now = _log_sum(steps[None] + (both[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(there[:, t + 1, None], now, 0.0)
    total = _log_sum(ahead[:, -1], 1)
    main = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
    pair = np.exp(ahead[:, :-1, :, None] + steps[None, None] + (both[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
    pair = np.where(there[:, 1:, None, None], pair, 0.0)
    seen = np.zeros((2, 2))
    inside = there[:, 1:]
    np.add.at(seen, (labels[:, :-1][inside], labels[:, 1:][inside]), 1)
    value = float((emit * labels * there).sum() + (seen * steps).sum() - total.sum())
    return value, (labels - main) * there, seen - pair.sum((0, 1))


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.1, l2: float = 0.004, least: int = 2) -> Field:
    """A field by gradient steps of adapted size on the penalised likelihood; features seen in fewer than least pages are left out."""
    pages = [(f, y) for f, y in pages if f]
    if not pages:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    count: dict[str, int] = {}
    for blocks, _ in pages:
        for name in {n for names in blocks for n in names}:
            count[name] = count.get(name, 0) + 1
    index = {name: k for k, name in enumerate(sorted(n for n, c in count.items() if c >= least))}
    lengths = np.array([len(y) for _, y in pages])
    longest = int(lengths.max())
    at, row = [], []
    labels = np.zeros((len(pages), longest), np.int64)
    for p, (blocks, y) in enumerate(pages):
        labels[p, : len(y)] = y
        for t, names in enumerate(blocks):
            known = [index[n] for n in names if n in index]
            at += known
            row += [p * longest + t] * len(known)
    at, row = np.array(at, np.int64), np.array(row, np.int64)
    x = np.zeros(len(index) + 4)
    first, second = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        emit = np.bincount(row, weights=x[at], minlength=len(pages) * longest).reshape(len(pages), longest)
        _, by_emit, by_step = likelihood(emit, x[-4:].reshape(2, 2), labels, lengths)
        g = np.concatenate([np.bincount(at, weights=by_emit.reshape(-1)[row], minlength=len(index)), by_step.reshape(-1)]) / len(pages) - l2 * x / math.sqrt(len(pages))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return Field(dict(zip(index, x[:-4].tolist())), x[-4:].reshape(2, 2).tolist())


def marked_blocks(html: str) -> tuple[list[tuple[tuple, str, int]], list[int]]:
    """Blocks and labels of a labelled page."""
    found = leaf_blocks(html)
    return [(path, text.replace(MARK, ""), min(linked, len(text.replace(MARK, "")))) for path, text, linked in found if text != MARK], [int(text.startswith(MARK)) for _, text, _ in found if text != MARK]


def train(labelled: DataFrame, sample: int = SAMPLE_PAGES) -> Field:
    """A field from at most sample labelled pages (html, whose main blocks start with MARK), the first by a hash.

    Null and empty pages teach nothing; without pages every block is labelled other.
    """
    rows = labelled.where("html is not null").select("html").orderBy(F.xxhash64("html"), "html").limit(sample)
    pages = [marked_blocks(r["html"]) for r in rows.toLocalIterator()]
    return fit([(features(blocks), labels) for blocks, labels in pages])


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_main for each row: the texts of its main blocks, joined by line ends.

    A null or empty page, and one without a main block, has an empty text. Repeated rows and rows without page_id are
    pages of their own; an empty table gives no rows; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast((field.weights, field.steps))

    def read(batches):
        known = Field(*sent.value)
        for batch in batches:
            texts, blocks_seen, main_seen = [], [], []
            for html in batch.column("html").to_pylist():
                blocks = leaf_blocks(html) if html else []
                main = [text for (_, text, _), y in zip(blocks, known.label(blocks)) if y]
                texts.append("\n".join(main))
                blocks_seen.append(len(blocks))
                main_seen.append(len(main))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks_seen, pa.int64()), pa.array(main_seen, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    there = set(pages.columns)
    kept = pages.select(*[F.col(c).cast(t) if c in there else F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))])
    return kept.mapInArrow(read, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
