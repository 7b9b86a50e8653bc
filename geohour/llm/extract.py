"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from geohour.llm.common import struct_type
from geohour.llm.markup import tags

PATH, WORDS, HIDDEN = 128, 32, 16  # sizes of the hashed vectors and of each direction's state
MAX_TRAIN_PAGES = 150  # pages of the table that the fit may read, the first by hash of their id
MAX_TRAIN_BYTES = 200_000  # longer pages are not taken into the fit
MADE_PAGES = 600  # pages that the generator adds
TRAIN_BLOCKS = 160  # training cuts longer pages into stretches of so many blocks
ROUNDS = 14
CACHED_WORDS = 200_000

_HINTS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
# Elements that end the running block. Others, as b, a, span or br, lie inside one.
_BLOCK = frozenset(
    "html head body title p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th article "
    "section main header footer nav aside form fieldset blockquote pre hr figure figcaption details "
    "summary address button select option label caption".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCK - {"html", "head", "body", "title"}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, with decoded references and single spaces; none empty."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            found.append(Block(tuple(x for _, names in stack for x in names), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def drop(depth: int):
        nonlocal links
        links -= sum(1 for t, _ in stack[depth:] if t == "a")
        del stack[depth:]

    for found_tag in tags(page):
        if found_tag.start > at:
            parts.append(page[at:found_tag.start])
            linked += (found_tag.start - at) * (links > 0)
        at, tag = found_tag.end, found_tag.name
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag in _VOID:
            parts.append(" ")
        if found_tag.closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                drop(depth)
            continue
        if tag in _VOID:
            continue
        ends = _SELF_CLOSING.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    drop(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        hints = [w for a in _HINTS.findall(found_tag.attributes) for w in _WORD.findall("".join(a).lower())]
        if tag in _BLOCK or tag == "a":
            stack.append((tag, (tag, *("." + w for w in hints))))
            links += tag == "a"
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found


_path_cache: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    got = _path_cache.get(path)
    if got is None:
        got = np.zeros(PATH, np.float32)
        for name in path:
            got[crc32(name.encode()) % PATH] += 1
        got = np.minimum(got, 2)
        if len(_path_cache) > 20_000:
            _path_cache.clear()
        _path_cache[path] = got
    return got


class _WordBuckets(dict):
    """Word to its bucket."""

    def __missing__(self, word: str) -> int:
        got = crc32(word.encode(errors="replace")) % WORDS
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = got
        return got


_word_buckets = _WordBuckets()


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: hashed tag path, all of its words hashed, and shares of the text."""
    x = np.zeros((len(blocks), PATH + WORDS + 8), np.float32)
    for i, b in enumerate(blocks):
        x[i, :PATH] = _path_vector(b.path)
        words = b.text.split(" ")
        codes = np.fromiter(map(_word_buckets.__getitem__, words), np.int64, len(words))
        x[i, PATH:PATH + WORDS] = np.bincount(codes, minlength=WORDS) / len(words)
        n = len(b.text)
        x[i, PATH + WORDS:] = (
            np.log1p(n) / 6, np.log1p(len(words)) / 5, b.linked / n, sum(map(b.text.count, ".,;!?")) / n * 10,
            b.text[-1:] in ".!?", i / len(blocks), len(blocks) < 5, 1)
    return x


@dataclass
class Labeller:
    """Weights of the two directions (input, state and bias in one matrix each) and the output."""

    forward: np.ndarray
    backward: np.ndarray
    out: np.ndarray

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """P(main text) of every block of every page; pages of like length run together."""
        got: list = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # at most 128 pages and a bounded padded size at once
            take = [order[at]]
            while (at + len(take) < len(order) and len(take) < 128
                   and (len(take) + 1) * len(pages[order[at + len(take)]]) <= 20_000):
                take.append(order[at + len(take)])
            x, size = _padded([pages[i] for i in take])
            p = _score(self, x, size)
            for k, i in enumerate(take):
                got[i] = p[k, :size[k]]
            at += len(take)
        return got


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), size.max(), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)] = p
    return x, size


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _reversed(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each page's blocks in the opposite order; padding stays behind."""
    at = np.arange(x.shape[1])[None, :]
    return np.take_along_axis(x, np.where(at < size[:, None], size[:, None] - 1 - at, at)[:, :, None], axis=1)


def _scan(w: np.ndarray, base: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """States of one direction, and what its gradient needs; `base` is the input's part of the gates."""
    pages, steps = base.shape[:2]
    recurrent = w[-1 - HIDDEN:-1]
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    states, kept = np.zeros((pages, steps, HIDDEN), np.float32), []
    for t in range(steps):
        z = base[:, t] + h @ recurrent
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        before, c_before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[:, t] = h
        if keep:
            kept.append((before, c_before, i, f, o, g, tc))
    return states, kept


def _base(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:x.shape[2]] + w[-1]


def _score(m: Labeller, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """P(main text) without what training keeps: memory for a few numbers a block besides `x`."""
    hf = _scan(m.forward, _base(m.forward, x), keep=False)[0]
    hb = _reversed(_scan(m.backward, _reversed(_base(m.backward, x), size), keep=False)[0], size)
    z = hf @ m.out[:HIDDEN] + hb @ m.out[HIDDEN:2 * HIDDEN] + x @ m.out[2 * HIDDEN:-1] + m.out[-1]
    return _sigmoid(z)


def _scan_gradient(w: np.ndarray, x: np.ndarray, kept: list, d_states: np.ndarray) -> np.ndarray:
    pages, steps, width = x.shape
    dz = np.zeros((pages, steps, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    g_state = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        before, c_before, i, f, o, g, tc = kept[t]
        dh = dh + d_states[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[:, t] = np.concatenate([
            dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        g_state += before.T @ dz[:, t]
        dh = dz[:, t] @ w[width:-1].T
        dc = dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return np.concatenate([x.reshape(-1, width).T @ flat, g_state, flat.sum(axis=0, keepdims=True)])


def _forward(m: Labeller, x: np.ndarray, size: np.ndarray) -> tuple:
    back = _reversed(x, size)
    hf, kf = _scan(m.forward, _base(m.forward, x))
    hb, kb = _scan(m.backward, _base(m.backward, back))
    seen = np.concatenate([hf, _reversed(hb, size), x, np.ones((*x.shape[:2], 1), np.float32)], axis=2)
    return _sigmoid(seen @ m.out), seen, back, kf, kb


def new_labeller(seed: int = 7) -> Labeller:
    rng, width = np.random.default_rng(seed), PATH + WORDS + 8
    def matrix():
        w = rng.normal(0, 0.1, (width + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32)
        w[-1, HIDDEN:2 * HIDDEN] = 1  # remember by default
        return w
    return Labeller(matrix(), matrix(), np.zeros(2 * HIDDEN + width + 1, np.float32))


def train(m: Labeller, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = ROUNDS,
          rate: float = 0.01, seed: int = 7) -> Labeller:
    """Cross-entropy over all blocks by Adam, through time in both directions."""
    pieces = [(p[a:a + TRAIN_BLOCKS], y[a:a + TRAIN_BLOCKS]) for p, y in zip(pages, labels)
              for a in range(0, len(p), TRAIN_BLOCKS)]
    pieces.sort(key=lambda e: len(e[0]))
    groups = [pieces[a:a + 16] for a in range(0, len(pieces), 16)]
    rng, step = np.random.default_rng(seed), 0
    weights = [m.forward, m.backward, m.out]
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for r in range(rounds):
        for k in rng.permutation(len(groups)):
            x, size = _padded([e[0] for e in groups[k]])
            y = np.zeros(x.shape[:2], np.float32)
            mask = np.arange(x.shape[1])[None, :] < size[:, None]
            for i, e in enumerate(groups[k]):
                y[i, :size[i]] = e[1]
            p, seen, back, kf, kb = _forward(m, x, size)
            d = ((p - y) * mask / mask.sum()).astype(np.float32)
            d_seen = d[:, :, None] * m.out
            grads = [
                _scan_gradient(m.forward, x, kf, d_seen[:, :, :HIDDEN]),
                _scan_gradient(m.backward, back, kb, _reversed(d_seen[:, :, HIDDEN:2 * HIDDEN], size)),
                seen.reshape(-1, seen.shape[2]).T @ d.reshape(-1)]
            step += 1
            now = rate * (0.3 if r > rounds * 0.7 else 1)
            for w, g, a, b in zip(weights, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


# Names that mark main text and names that mark the rest, for the training labels.
MAIN_NAMES = "article main .content .article .post .entry .story .body .text".split()
OTHER_NAMES = (
    "head nav footer header aside form button select label .nav .menu .navigation .breadcrumb .footer "
    ".header .sidebar .aside .ad .ads .advert .advertisement .banner .promo .sponsored .cookie .notice .consent "
    ".alert .popup .modal .newsletter .subscribe .share .social .related .comment .comments .reply .replies "
    ".widget .login .search .pagination").split()
_MAIN, _OTHER = frozenset(MAIN_NAMES), frozenset(OTHER_NAMES)


def weak_label(path: tuple[str, ...]) -> bool:
    """What a page's own markup says of a block: inside main text and nothing else in between."""
    return not _MAIN.isdisjoint(path) and _OTHER.isdisjoint(path)


# Marks the main text of generated pages; it lies in the private use area and is taken out again.
_TRUE = "\ue000"


def made_page(rng: np.random.Generator) -> str:
    """A page of random words and of a random layout, its main blocks marked.

    Half of the pages name nothing: their parts are plain elements, or have names without meaning.
    """
    # A page has words of its own, few of them frequent, as in any language: no word tells main text.
    letters = "etaoinshrdlucmfwypvbgk"
    own = ["".join(letters[int(k)] for k in np.minimum(rng.geometric(0.12, rng.integers(1, 10)) - 1, 21)) for _ in range(300)]
    often = np.cumsum(1 / np.arange(1, 301) ** rng.uniform(0.3, 1.2))

    def words(low: int, high: int) -> str:
        n = rng.integers(low, high)
        return " ".join(own[k] for k in np.searchsorted(often, rng.random(n) * often[-1]).tolist())

    def pick(*of: str) -> str:
        return of[int(rng.integers(len(of)))]

    def paragraph() -> str:
        text = _TRUE + ". ".join(words(3, 14).capitalize() for _ in range(rng.integers(1, 6))) + "."
        if in_divs and rng.random() < 0.85:
            return pick(f"<div>{text}</div>", f"<div{own_name}>{text}</div>", f"<div{own_name}><span>{text}</span></div>")
        return pick(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}</p>", f"<h2>{_TRUE}{words(2, 6)}</h2><p>{text}</p>",
                    f"<ul><li>{_TRUE}{words(2, 9)}</li><li>{_TRUE}{words(2, 9)}</li></ul>", f"<blockquote>{text}</blockquote>",
                    f"<p>{_TRUE}{words(1, 3)}</p>")

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{i}">{words(1, 4)}</a>' for i in range(rng.integers(low, high))]
        return pick("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items))

    def plain_name() -> str:
        return pick("", "", f' class="{pick(*"abcdefghk")}{rng.integers(1, 99)}"', f' id="{words(1, 2)}"', f' class="{words(1, 3)}"',
                    f' class="{pick("col", "row", "box", "wrap", "inner", "left", "right", "page", "grid", "block")}-{rng.integers(1, 12)}"')

    def plain_other() -> str:
        inner = pick(links(2, 9), f"<h3>{words(1, 4)}</h3>{links(2, 7)}", f"<p>&copy; {rng.integers(1990, 2030)} {words(1, 5)}</p>",
                     f'<p>{words(1, 5)} <a href="/x">{words(1, 3)}</a></p>', f"<h4>{words(1, 3)}</h4><p>{words(1, 5)}</p>",
                     f'<a href="/">{words(1, 3)}</a>', f"<span>{words(1, 3)}</span>", f"<form>{words(1, 4)}<button>{words(1, 2)}</button></form>")
        return f"<div{plain_name()}>{inner}</div>"

    def other() -> str:
        if plain:
            return plain_other()
        name = pick(*[n for n in OTHER_NAMES if n not in ("head", "label", "select", "button")])
        inner = pick(links(2, 8), words(3, 30).capitalize() + ".", f"<p>{words(4, 30)}.</p><p>{words(2, 20)}</p>",
                     f"<h3>{words(1, 4)}</h3><p>{words(4, 40)}.</p>")
        kind = pick("div", "section", "div") if name[0] == "." else name
        mark = f' {pick("class", "id")}="{name[1:]}{pick("", "-1", " box")}"' if name[0] == "." else ""
        return f"<{kind}{mark}>{inner}</{kind}>"

    def others(low: int, high: int) -> str:
        return "".join(other() for _ in range(rng.integers(low, high)))

    plain = rng.random() < 0.5
    in_divs = plain and rng.random() < 0.4
    own_name = plain_name()
    name = pick("article", "article", "article", "main", *MAIN_NAMES)
    kind, mark = ("div", f' class="{name[1:]}"') if name[0] == "." else (name, "")
    if plain:
        kind, mark = pick("div", "div", "section", "td"), plain_name()
    inside = "".join(paragraph() + (other() if rng.random() < 0.08 else "")
                     for _ in range(rng.integers(2 if plain else 1, 14)))
    title = words(2, 9)
    head = f"<h1>{_TRUE}{title}</h1>" if rng.random() < 0.9 else ""
    around = (others(1, 5), others(1, 5)) if plain else (others(0, 4), others(0, 4))
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p>';</script></head><body>"
            f"{around[0]}<{kind}{mark}>{head}{inside}</{kind}>{around[1]}"
            + (f"<footer>&copy; {words(1, 5)}</footer>" if not plain and rng.random() < 0.7 else "") + "</body></html>")


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a generated page, without the marks, and which of them are main text."""
    found = blocks_of(page)
    truth = np.array([_TRUE in b.text for b in found], np.float32)
    return [Block(b.path, b.text.replace(_TRUE, ""), b.linked) for b in found], truth


def weakly_labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page and what its markup says of them; none if it names no main text."""
    found = blocks_of(page)
    if all(_MAIN.isdisjoint(b.path) for b in found):
        return [], np.zeros(0, np.float32)
    return found, np.array([weak_label(b.path) for b in found], np.float32)


def fit(pages: DataFrame, body: str = "html", page_id: str = "page_id", max_pages: int = MAX_TRAIN_PAGES,
        made: int = MADE_PAGES, seed: int = 7) -> Labeller:
    """A labeller from `made` generated pages and at most `max_pages` pages of the table.

    Generated pages know their main text. Pages of the table are labelled by their markup
    (`weak_label`); those whose markup names no main text teach nothing and are left out, so they
    are judged by what the labeller has learnt elsewhere. The sample takes pages of at most
    MAX_TRAIN_BYTES, so it fits the driver: `max_pages` times that.
    """
    # Only ids are compared across tasks; pages themselves come for the chosen ids alone.
    short = pages.where(F.octet_length(body) <= MAX_TRAIN_BYTES)
    chosen = short.select(F.col(page_id).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_pages)
    rows = short.select(page_id, body).join(
        F.broadcast(chosen), F.col(page_id) == F.col("__id")).groupBy(page_id).agg(F.min(body)).orderBy(page_id).collect()
    rng = np.random.default_rng(seed)
    examples = [weakly_labelled(r[1]) for r in rows] + [labelled(made_page(rng)) for _ in range(made)]
    examples = [(b, y) for b, y in examples if b]
    return train(new_labeller(seed), [vectors(b) for b, _ in examples], [y for _, y in examples], seed=seed)


def extract(pages: DataFrame, labeller: Labeller, keep: tuple[str, ...] = ("page_id", "url"),
            body: str = "html") -> DataFrame:
    """One row per row of `pages`: the `keep` columns, text and n_chars.

    text joins, one per line, all blocks that the labeller holds for main text, in page order;
    it is empty if there are none, as for null or empty html. Whole pages are read and nothing
    is cut; time and memory grow with a page's length, whatever its markup. Equal rows give equal texts; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(
        Labeller(labeller.forward, labeller.backward, labeller.out))  # a few thousand weights

    @arrow_udf(struct_type("text string, n_chars long"))
    def main_text(column: pa.Array) -> pa.Array:
        parsed = [blocks_of(x or "") for x in column.to_pylist()]
        got = []
        for a in range(0, len(parsed), 256):
            part = parsed[a:a + 256]
            for blocks, p in zip(part, shared.value.probabilities([vectors(b) for b in part])):
                got.append("\n".join(b.text for b, q in zip(blocks, p) if q >= 0.5))
        return pa.StructArray.from_arrays([pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())],
                                          ["text", "n_chars"])

    out = pages.select(*[F.col(c).alias(f"__{c}") for c in keep], main_text(F.col(body)).alias("__t"))
    return out.select(*[F.col(f"__{c}").alias(c) for c in keep], "__t.text", "__t.n_chars")
