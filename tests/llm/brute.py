"""Plain Python answers the operators are compared with."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def suffix(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    often = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if often[b[i:i + width]] > 1:
                gone[i:i + width] = b"\x01" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, n=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest reachable node, for nodes that can be compared."""
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def simhash(docs):
    fps = {i: fingerprint(t) for i, t in docs}
    kinds = sorted(set(fps.values()))
    links = [(a, b) for k, a in enumerate(kinds) for b in kinds[k + 1:] if (a ^ b).bit_count() <= 2]
    root = components(kinds, links)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    return {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}


_PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, width=10):
    at = defaultdict(set)
    for item, text in items:
        words = _PLAIN.findall((text or "").translate(LOWER))
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            at[tuple(words[i:i + n])].add(str(item))
    sizes = {len(w) for w in at}
    out = {}
    for i, text in docs:
        words = _PLAIN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                own = at.get(tuple(words[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def lines(docs, least=10):
    def key(x):
        return x.strip(" \t\n\x0b\f\r").translate(LOWER)

    split = [(i, (t or "").split("\n")) for i, t in docs]
    often = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for i, ls in split:
        kept = [x for x in ls if often[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def similarity(a, b, n=5):
    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


# -- two tokenizers ------------------------------------------------------------------

def byte_alphabet():
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(others)}


def alignment(rows, byte_file, piece_file):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), by comparing every A with every B token."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(byte_file)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    alphabet, entry = byte_alphabet(), {i: t for t, i in left.get_vocab().items()}

    def right_bytes(i):
        piece = right.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode()

    def ranges(ids, body):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(body(i)), i))
            at = out[-1][1]
        return out

    docs = []
    for doc_id, text in rows:
        a = b = []
        if text:
            a = ranges(left.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(alphabet[c] for c in entry[i]))
            b = ranges(right.encode(text), right_bytes)
            for side, body in ((a, lambda i: bytes(alphabet[c] for c in entry[i])), (b, right_bytes)):
                if b"".join(body(i) for _, _, i in side) != (" " + text).encode():
                    a = b = []
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else _swept(a, b)
        cuts = [0, *sorted({e for _, e, _ in a} & {e for _, e, _ in b})]
        groups = []
        for lo, hi in zip(cuts, cuts[1:]):
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in (a, b)) if len(a) < 3000 else "")
        docs.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    held = Counter(p for d in docs for p in set(d[4]))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [
        (i, na, nb, ng, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(groups.encode()).hexdigest() if na else "") for i, na, nb, ng, links, groups in docs]


def _swept(a, b):
    """Links of long texts: the tokens that hold each byte offset where either one begins."""
    out, j, k = [], 0, 0
    while j < len(a) and k < len(b):
        out.append((a[j][2], b[k][2]))
        ends = a[j][1], b[k][1]
        j += ends[0] <= ends[1]
        k += ends[1] <= ends[0]
    return out


# -- conversation tries -----------------------------------------------------------------

def trie(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of rows (conv_id, turn, role, text)."""
    import zlib

    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = defaultdict(set)
    for p in members:
        if p:
            below[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()]
