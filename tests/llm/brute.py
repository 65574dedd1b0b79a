"""Plain Python versions of the operators without SQL: no Spark, no arrays, every pair compared."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex
import xxhash
import zstandard

from arbalest.llm import decontamination, language_id

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def id_text(doc_id):
    return "" if doc_id is None else str(doc_id)


def remainder(doc_id, n):
    return zlib.crc32(id_text(doc_id).encode()) % n


def text_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


# language ID


def dictionaries(rows):
    """rows: (text, lang)."""
    least = defaultdict(dict)
    for text, lang in rows:
        if text is not None and lang is not None:
            h = text_hash(text)
            bucket = least[lang]
            if h % language_id.SAMPLE not in bucket or h < bucket[h % language_id.SAMPLE][0]:
                bucket[h % language_id.SAMPLE] = (h, text)
    out = []
    for lang in sorted(least, key=str.encode):
        parts = []
        for _, text in sorted(least[lang].values()):
            start = max(1, len(text) // 2 - language_id.SAMPLE_CHARS // 2) - 1
            parts.append(text[start : start + language_id.SAMPLE_CHARS])
        out.append((lang, "\n".join(parts).lower().encode()[: language_id.DICTIONARY]))
    return out


def language(text, known):
    """(lang_pred, score)"""
    if not known or not regex.search(r"\p{L}", text or ""):
        return "und", 0.0
    if len(known) == 1:
        return known[0][0], 1.0
    data, found = text.lower().encode(), []
    for name, content in known:
        book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=language_id.LEVEL)
        size = 0
        for at in range(0, len(data), language_id.PIECE):
            size += len(zstandard.ZstdCompressor(dict_data=book, write_content_size=False).compress(data[at : at + language_id.PIECE]))
        found.append((size, name.encode(), name))
    (first, _, name), (second, _, _) = sorted(found)[:2]
    return name, (second - first) / second


# SimHash


def fingerprint(text):
    ws = words(lower(text))
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def alike(texts):
    """Components of five-word shingle similarity 0.8 or more, by all pairs."""
    sets = []
    for text in texts:
        ws = words(lower(text))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def keep_one(rows):
    """rows: dicts. Of each component the row of the smallest (id, text hash)."""
    roots = alike([r["text"] for r in rows])
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, text_hash(r["text"]))
    return [min((r for r, x in zip(rows, roots) if x == c), key=order) for c in sorted(set(roots))]


# decontamination


def _small(letter):
    """The small letter of one of one or two bytes."""
    low = letter.lower()
    return low if len(low) == 1 and ord(letter) < 0x800 and len(low.encode()) == len(letter.encode()) else letter


def _lower_accents(word):
    return "".join(map(_small, word))


def template(text):
    """Tokens as (kind, plain text or None, slot value or None)."""
    marked, end, closed = [], 0, True
    for m in WORDS.finditer(text or ""):
        opens = closed or "\n" in text[end : m.start()]
        core = re.sub(r"^[^0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff]+$", "", m[0])
        if core:
            marked.append((core, opens))
        end, closed = m.end(), m[0][-1] in ".!?:;"
    tokens, was_number, was_name = [], False, False
    for core, opens in marked:
        low = _lower_accents(core)
        number = core[0] in "0123456789" or low in decontamination.NUMBERS
        unit = low in decontamination.UNITS and was_number and not number
        capital = _small(core[0]) != core[0] and len(core.encode()) > 1 and not (len(core) > 1 and _small(core[1]) != core[1])
        name = bool(capital) and not opens and not number and not unit
        if name and was_name:
            tokens[-1] = ("name", None, tokens[-1][2] + (low,))
        elif number or unit or name:
            tokens.append(("number" if number else "unit" if unit else "name", None, (low,)))
        else:
            tokens.append(("plain", low, None))
        was_number, was_name = number, name
    return tokens


def _windows(tokens, sizes):
    for size in sizes:
        for at in range(len(tokens) - size + 1):
            part = tokens[at : at + size]
            plain = sum(kind == "plain" for kind, _, _ in part)
            if plain >= (decontamination.PLAIN if size == decontamination.WIDTH else 1):
                yield at, size, tuple((kind, word) for kind, word, _ in part), [value for kind, _, value in part if kind != "plain"]


def leaks(docs, items):
    """docs, items: sets of (id, text). {(doc id, text, item id): (n_tokens, n_covered, exact, first_token)}"""
    wide, filed, total = decontamination.WIDTH, defaultdict(list), {}
    for item in items:
        tokens = template(item[1])
        total[item] = len(tokens)
        for at, size, key, slots in _windows(tokens, [min(wide, len(tokens))] if tokens else []):
            filed[key].append((item, at, slots))
    out = {}
    for doc in docs:
        hits = defaultdict(list)
        for pos, size, key, slots in _windows(template(doc[1]), range(1, wide + 1)):
            for item, at, item_slots in filed.get(key, ()):
                hits[item].append((pos - at, pos, at, size, item_slots, slots))
        for item, found in hits.items():
            sessions, last = [], None
            for hit in sorted(found, key=lambda h: h[0]):
                if last is None or hit[0] - last > decontamination.DRIFT:
                    sessions.append([])
                sessions[-1].append(hit)
                last = hit[0]
            good = []
            for session in sessions:
                covered = {t for _, _, at, size, _, _ in session for t in range(at, at + size)}
                values = defaultdict(set)
                for *_, item_slots, slots in session:
                    for a, b in zip(item_slots, slots):
                        values[a].add(b)
                if len(covered) >= decontamination.COVER * total[item] and all(len(v) == 1 for v in values.values()):
                    good.append((len(covered), -min(h[1] for h in session), all(v == {a} for a, v in values.items())))
            if good:
                n, first, exact = max(good)
                out[doc[0], doc[1], item[0]] = (total[item], n, exact, -first)
    return out


# mixing and sharding


def mixed(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Each row as often as the mix takes it."""
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    order = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
    weight, total, full = {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(size.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        rate = (share * total - cap * sum(size[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if rate * weight[s] > cap * size[s]}
        if not more:
            break
        full |= more
    out = []
    for s in order:
        target = math.floor(cap * size[s] if s in full else rate * weight[s])
        mine = [(hashlib.md5(f"{id_text(r['doc_id'])}:{r['text'] or ''}".encode()).hexdigest(), len(words(r["text"])), r) for r in rows if r["source"] == s]
        ahead = 0
        for _, n, r in sorted(mine, key=lambda x: x[:2]):
            taken = target // size[s] * n + max(0, min(target % size[s] - ahead, n)) if size[s] else 0
            ahead += n
            out += [r] * ((2 * taken + n) // (2 * n) if n else 0)
    return out


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def sharded(rows, shards=16):
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)"""
    placed = defaultdict(list)
    for r in rows:
        data, key = (r["text"] or "").encode(), (r["doc_id"] or 0) % (1 << 64)
        crc = zlib.crc32(data)
        bucket = hashlib.md5(f"{id_text(r['doc_id'])}:{crc}".encode()).hexdigest()[:3]
        placed[jump(key, shards)].append((bucket, r["doc_id"] is not None, r["doc_id"] or 0, crc, len(data) + 1, jump(key, shards + 1)))
    return [(i if some else None, size, crc, "key", shard, slot, grown) for shard, held in placed.items() for slot, (_, some, i, crc, size, grown) in enumerate(sorted(held))]
