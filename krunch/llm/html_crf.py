"""Main text of pages by a linear-chain conditional random field over their leaf blocks.

States are article and rest. Features are the elements around a block with their class, id and role names, the shape of
its text (length, links, sentences, stops, capitals, words that are repeated) and that of the blocks beside it. A third of the
training pages have no names and no speaking elements, so that text decides there. The weights are the maximum of the penalised log-likelihood on labelled pages, found with exact
gradients by forward and backward sums; pages are decoded by Viterbi.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, sliced
from .html_blocks import Block, Node, blocks
from .html_pages import page

#: Labelled pages to train on, steps of the optimiser, weight of the penalty.
PAGES, STEPS, PENALTY = 1000, 250, 1e-3
#: Every so many pages, one is cut off somewhere, as fetched pages are.
CUT_EVERY = 4


def _path_features(node: Node | None) -> tuple[str, ...]:
    """Kept with the node: blocks of one parent share them."""
    if node is None:
        return ("bare",)
    if node.features is None:
        out = [f"up0:{node.element.split('.')[0]}"]
        if node.parent:
            out.append(f"up1:{node.parent.element.split('.')[0]}")
        for name in node.seen:
            out.append(f"in:{name}")
            if name.endswith("s"):
                out.append(f"in:{name[:-1]}")
        if not node.seen & SPEAKING:
            out.append("plain")
        node.features = tuple(dict.fromkeys(out))
    return node.features


#: Elements that say what they hold.
SPEAKING = frozenset("article main nav header footer aside form menu dialog".split())
_SENTENCE = re.compile(r"""[.!?…。！？]["')»”]?(?:\s|$)""")
_WORD = re.compile(r"\w+")


def _shape(b: Block) -> tuple[str, ...]:
    """Of a block's own text, all of it."""
    text, n = b.text, len(b.text)
    words = capital = 0
    for found in _WORD.finditer(text):  # one at a time: a block may be a whole book
        words += 1
        capital += text[found.start()].isupper()
    share = b.linked / n if n else 0
    stops = sum(1 for _ in _SENTENCE.finditer(text))
    return (
        f"size:{min(6, n.bit_length() // 2)}",
        f"links:{0 if share == 0 else 1 if share < 0.5 else 2}",
        f"stops:{min(3, stops)}",
        f"ends:{int(text[-1:] in '.!?…。！？')}",
        f"words:{min(5, words.bit_length())}",
        f"capitals:{0 if not words else 4 * capital // words}",
        *(("sign:copyright",) if "©" in text else ()),
        *(("sign:bar",) if "|" in text or "»" in text else ()),
    )


def features(some: list[Block]) -> list[tuple[str, ...]]:
    """Of each block of a page, with the size and links of the blocks beside it."""
    shapes = [_shape(b) for b in some]
    out = []
    for k, (b, own) in enumerate(zip(some, shapes, strict=True)):
        path = _path_features(b.node)
        # where no element or name tells, the shape of the text has weights of its own
        plain = "plain" in path or path == ("bare",)
        alone = tuple(f"plain:{x}" for x in own) if plain else ()
        beside = [f"before:{x}" for x in shapes[k - 1][:2]] if k else ["before:none"]
        beside += [f"behind:{x}" for x in shapes[k + 1][:2]] if k + 1 < len(shapes) else ["behind:none"]
        if plain:
            beside = [f"plain:{x}" for x in beside]
        out.append((*path, *own, *alone, *beside))
    return out


@dataclass
class Crf:
    weights: dict[str, float]  #: of the difference between article and rest
    change: np.ndarray  #: log potentials of state pairs
    begin: np.ndarray
    end: np.ndarray

    def decode(self, some: list[Block]) -> list[bool]:
        """Viterbi."""
        if not some:
            return []
        get = self.weights.get
        (a, b), (c, d) = self.change.tolist()
        zero, one = self.begin.tolist()
        scores = [sum([get(f, 0.0) for f in x]) for x in features(some)]
        one += scores[0]
        back = []
        for score in scores[1:]:
            to_zero, to_one = zero + a < one + c, zero + b < one + d
            back.append((to_zero, to_one))
            zero, one = (one + c if to_zero else zero + a), (one + d if to_one else zero + b) + score
        state = bool(one + self.end[1] >= zero + self.end[0])
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, penalty: float = PENALTY) -> Crf:
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    longest = max(len(b) for b, _ in pages)
    count = len(pages)
    gold, mask = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    cell, feature = [], []
    for p, (some, labels) in enumerate(pages):
        for t, (own, label) in enumerate(zip(features(some), labels, strict=True)):
            gold[p, t], mask[p, t] = label, True
            for f in own:
                cell.append(p * longest + t)
                feature.append(names.setdefault(f, len(names)))
    cell, feature = np.array(cell), np.array(feature)
    last = mask.sum(axis=1) - 1
    theta = np.zeros(len(names) + 8)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    want = np.bincount(feature, weights=gold.reshape(-1)[cell], minlength=len(names))
    pairs = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    first_gold, last_gold = np.bincount(gold[:, 0], minlength=2), np.bincount(gold[np.arange(count), last], minlength=2)
    for step in range(1, steps + 1):
        w, change, begin, end = theta[: len(names)], theta[-8:-4].reshape(2, 2), theta[-4:-2], theta[-2:]
        emit = np.zeros((count, longest, 2))
        emit[:, :, 1] = np.bincount(cell, weights=w[feature], minlength=count * longest).reshape(count, longest)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = begin + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], emit[:, t] + np.logaddexp(ahead[:, t - 1, :1] + change[0], ahead[:, t - 1, 1:] + change[1]), ahead[:, t - 1])
        total = np.logaddexp(*(ahead[np.arange(count), last] + end).T)
        behind[np.arange(count), last] = end
        for t in range(longest - 2, -1, -1):
            onward = emit[:, t + 1] + behind[:, t + 1]
            value = np.stack([np.logaddexp(change[s, 0] + onward[:, 0], change[s, 1] + onward[:, 1]) for s in (0, 1)], axis=1)
            behind[:, t] = np.where((t < last)[:, None], value, behind[:, t])
        marginal = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        joint = np.exp(ahead[:, :-1, :, None] + change + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        have = np.bincount(feature, weights=marginal[:, :, 1].reshape(-1)[cell], minlength=len(names))
        gradient = np.concatenate([want - have, (pairs - joint.sum(axis=(0, 1))).reshape(-1), first_gold - marginal[:, 0].sum(axis=0), last_gold - marginal[np.arange(count), last].sum(axis=0)]) / count
        gradient -= penalty * theta
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Crf({n: float(theta[k]) for n, k in names.items()}, theta[-8:-4].reshape(2, 2).copy(), theta[-4:-2].copy(), theta[-2:].copy())


def labelled(seeds) -> list[tuple[list[Block], list[bool]]]:
    """Invented pages as blocks with labels; the reader must find the blocks that the page was made of."""
    out = []
    for seed in seeds:
        source, labels = page(seed)
        some, marks = [], iter(labels)
        if seed % CUT_EVERY == 0:
            source = source[: len(source) * (seed % 97 + 3) // 100]
        for b in blocks(source):
            text, label = next(marks, (None, False))
            if text is not None and text != b.text:  # inline text that the page maker joined to its neighbour
                label = next((v for t, v in labels if t == b.text), False)
            some.append((b, label))
        out.append(([b for b, _ in some], [v for _, v in some]))
    return out


@lru_cache(maxsize=1)
def model() -> Crf:
    """Trained once for each driver."""
    return train(labelled(range(PAGES)))


def main_text(page_html: str | None, crf: Crf) -> str:
    some = blocks(page_html)
    return "\n\n".join(b.text for b, keep in zip(some, crf.decode(some), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages. A null page is empty; a page without article has empty text.

    Blocks are joined in page order by a blank line; white space inside a block is one space.
    """
    crf = model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in sliced(batches):
            texts = [main_text(t, crf) for t in b.column(2).to_pylist()]
            yield batch(schema, b.column(0), b.column(1), texts, list(map(len, texts)))

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
