"""Plain versions of the operators' results, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile("[^\x20\x09-\x0D]+")


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = text or ""
    words = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if n[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def fingerprint(text):
    words = BLANK.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_components(docs):
    """{doc_id: (fingerprint, component)} of {doc_id: text}."""
    f = {d: fingerprint(t) for d, t in docs.items()}
    ids = sorted(f)
    all_f = np.array([f[d] for d in ids], np.uint64)
    links = [(ids[i], ids[i + 1 + j]) for i in range(len(ids))
             for j in np.flatnonzero(np.bitwise_count(all_f[i + 1:] ^ all_f[i]) <= 3)]
    c = components(links, ids)
    return {d: (f"{f[d]:016x}", c[d]) for d in ids}


def without_repeats(texts, size=200):
    """[(kept bytes, removed, runs)] of a list of byte strings."""
    n = Counter(t[i:i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if n[t[i:i + size]] > 1:
                gone[i:i + size] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((np.frombuffer(t, np.uint8)[~gone].tobytes(), int(gone.sum()), runs))
    return out


def contaminated_words(text, items):
    """(words, hit words, item ids) with items as {id: text}."""
    words = WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, phrase in items.items():
        w = WORD.findall((phrase or "").translate(LOWER))
        size = min(len(w), 10)
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def check_packing(rows, ids_of, sequence=1024):
    """Assert that the pieces hold each id of {doc_id: ids} once and leave no gap."""
    import zlib

    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.asarray(ids_of[r.doc_id], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids)
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == len(ids_of[d])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == sequence or (s == len(by_sequence) - 1 and at < sequence)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fill_in_middle(doc_id, text, seed=7):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def order_minhash(text, k=5, entries=64, ell=2):
    """Hex digits of the fingerprint of a text without blankless scripts."""
    def chain(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed=seed)
        return seed

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def raw(x):
        return (x & (1 << 64) - 1).to_bytes(8, "little")

    units = [chain([u.encode()]) for u in re.split(r"[ \t\n\x0b\f\r]+", text or "") if u]
    if not units:
        return ""
    h = [signed(chain([raw(u) for u in units[i:i + k]])) for i in range(max(len(units) - k, 0) + 1)]
    bits = len(bin(len(h))) - 2
    first, count, keys = {}, Counter(), []
    for i, x in enumerate(h):
        group = x >> bits
        first.setdefault(group, x)
        o = count[group]
        count[group] += 1
        key = x if not o else signed(chain([raw(first[group]), o.to_bytes(4, "little", signed=True)]))
        keys.append((key >> bits, i))
    out = []
    for e in range(entries):
        mark = (e * (1 << 64) // entries - (1 << 63)) >> bits
        order = sorted(keys, key=lambda x: ((x[0] - mark) % (1 << 64 - bits), x[1]))
        places = sorted(i for _, i in order[:min(ell, len(h))])
        out.append(f"{chain([raw(h[i]) for i in places]) >> 32:08x}")
    return "".join(out)


def share(a, b):
    if not a and not b:
        return 1.0
    same = sum(a[i:i + 8] == b[i:i + 8] for i in range(0, min(len(a), len(b)), 8))
    return same / (max(len(a), len(b)) // 8)


def edited(docs):
    """{doc_id: (edited text, next id)} of {doc_id: text}, by descending id."""
    ids = sorted(docs, reverse=True)
    out = {}
    for d, after in zip(ids, ids[1:] + ids[:1]):
        text, other = docs[d] or "", docs[after] or ""
        cut = len(text) // 3
        out[d] = text[:len(text) - cut] + other[:cut], after
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def variants(n, ratio=5):
    """{word: (form, root, n, n_near, form_n)} of {word: n}."""
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}
