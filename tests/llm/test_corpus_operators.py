"""Each operator against a brute-force version on rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbalest.llm import decontamination, language_id, licenses, lm_score, mixing, sharding, simhash, substring_dedup, topk, url_filter
from arbalest.llm import kernels as K
from llm_cases import document_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# top-k


def brute_topk(vectors, k):
    longs = lambda x: min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1)
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [longs(y) for y in v]
            whole[i] = min(whole.get(i, x), x)
    out = []
    for q, a in whole.items():
        if q % 4 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)[:k]
            out += [(q, r + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(best)]
    return sorted(out)


def check_topk(spark, rows, k):
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3).withColumns({c: F.lit("extra") for c in ("score", "x", "cell", "block", "d", "order")})
    assert sorted(tuple(r) for r in topk.search(frame, F.col("id") % 4 == 0, k).collect()) == brute_topk(rows, k)


def test_topk_is_exact_with_ties_and_bad_vectors(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.normal(size=6) * (1 + i % 7)]) for i in range(300)]
    rows += [(300 + i, [0.25, 0.5, -0.25, 1.0, 0.0, 0.125]) for i in range(40)]  # a hot vector
    rows += [(400, None), (404, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (408, [float("nan")] * 6), (412, [float("inf")] * 6)]
    rows += [(5, [9.0] * 6), (8, rows[8][1]), (None, [7.0] * 6), (None, None)]  # repeated and null ids
    check_topk(spark, rows, 5)


def test_topk_keeps_every_finite_vector(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in random.normal(size=4)]) for i in range(120)]
    rows += [(200, [40000.0, 0.0, 0.0, 0.0]), (204, [-3e9, 2e9, 1.0, 0.0]), (205, [1e12, 1e12, -1e12, 5.0]), (208, [1e300, -1e300, 0.0, 1.0]), (209, [1.5e300] * 4)]
    check_topk(spark, rows, 4)
    rows = [r for r in rows if r[0] < 205] + [(300, [1.0]), (304, [2.0, -1.0]), (305, []), (308, [float(x) for x in random.normal(size=9)]), (309, [50.0] * 7)]
    check_topk(spark, rows, 7)


def test_topk_of_nothing_and_of_few(spark):
    schema = "id long, vector array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("id") % 4 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0])], schema)
    assert [tuple(r) for r in topk.search(few, F.col("id") % 4 == 0).collect()] == [(0, 1, 2, 1024 * 1024), (0, 2, 1, 1024 * 512)]


# language ID


def test_language_id(spark, docs, empty):
    training = spark.createDataFrame([("the and of to in that is was he for it with as his on be at by", "en"), ("der die das und ist nicht ein eine mit von zu den", "de"), (None, "en"), ("x", None)], "text string, lang string")
    languages = language_id.fit(training)
    assert [name for name, _ in languages] == ["de", "en"]
    got = language_id.identify(docs, languages).collect()
    assert len(got) == len(document_rows())
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    kept = language_id.keep_identified(docs, languages)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0
    assert language_id.identify(empty, languages).collect() == [] and language_id.fit(empty) == []
    assert {r.lang_pred for r in language_id.identify(docs, []).collect()} == {"und"}
    assert {r.score for r in language_id.identify(docs.where("doc_id = 0"), languages[:1]).collect()} == {1.0}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    rows = spark.createDataFrame([(f"text {i}", f"l{i % 4}") for i in range(8)] + [("x", None)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        language_id.fit(rows)
    assert len(language_id.fit(rows.where("lang <> 'l3'"))) == 3


def test_language_id_by_piece_covers_whole_text():
    languages = [("a", b"alpha beta gamma " * 50), ("b", b"delta epsilon zeta " * 50)]
    import zstandard

    coders = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, d in languages]
    text = b"alpha beta gamma " * 10 + b"delta epsilon zeta " * 2000
    assert np.argmin(language_id.sizes(text, coders)) == 1


# mixing


def test_mixing_reaches_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    size = Counter()
    for r in document_rows():
        size[r[3]] += len(words(r[1]))
    order = sorted([s for s in size if s is not None]) + [None]
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(size.values())
    capped = set()
    while True:
        rate = (1.5 * total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and rate * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * size[s] if s in capped else rate * weight[s] for s in order}
    by_size = defaultdict(set)
    for s in order:
        by_size[size[s]].add(target[s])
    assert len(rows) == len(document_rows())
    for r in rows:
        assert any(math.isclose(r.target, t) for t in by_size[r.source_size]) and 0 <= r.taken <= 2 * r["size"]
    assert sum(r.taken for r in rows) == sum(math.floor(t) for t in target.values())
    positions = [r.first_position for r in rows if r.first_position is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert mixing.mix(empty).collect() == []
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))


def test_curriculum_repeats_rows(docs, empty):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        if r["size"]:
            taken[r.doc_id] += math.floor((2 * r.taken + r["size"]) / (2 * r["size"]))
    got = mixing.curriculum(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == +taken
    assert mixing.curriculum(empty).collect() == []


def test_mixing_without_words(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix(rows).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


# licences


def test_license_places(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for row in document_rows():
        ws = split.findall(lower(row[1]))
        places = [(i, label) for text, label in licenses.BASE for i in range(len(ws)) if ws[i : i + len(text.split())] == text.split()]
        r = got[row[0], len(ws)]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
    assert licenses.scan(empty).collect() == []


def test_a_word_of_every_document_still_has_to_stand_in_its_place(spark):
    texts = ["apache license version 2 and the", "the apache license stub 2", "license 2 the", "2 license the version apache"]
    texts = [f"{t} license 2" for t in texts]  # "license" and "2" have an idf of 0
    frame = spark.createDataFrame([*enumerate(texts), (9, "apache 2 version license 2")], "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.labels) for r in licenses.scan(frame).collect()}
    assert got == {0: (1, "apache-2"), 1: (0, ""), 2: (0, ""), 3: (0, ""), 9: (0, "")}
    near = spark.createDataFrame([(1, "apache shield version 2 license"), (2, "license 2")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(near, base=(("apache license version", "x"),), templates=()).collect()] == ["", ""]


def test_reworded_licences_are_found_by_the_words_that_are_left(spark):
    long = [t for t in licenses.TEMPLATES if len(t[2].split()) > 20]
    texts, want = [], []
    for label, key, text in long:
        ws = text.split()
        spare = [i for i in range(len(ws)) if not any(k <= i < k + len(key.split()) for k in licenses.key_places((label, key, text)))]
        for changed in (spare[::9], spare[3::7], spare[:1]):
            texts.append("some words of another kind " + " ".join("changed" if i in changed else w for i, w in enumerate(ws)) + " and so on")
            want.append(label)
        texts.append(" ".join("changed" if w in key.split() else w for w in ws))  # no key phrase: no label
        want.append(None)
        texts.append(" ".join(ws[len(ws) // 2 :: 2]))  # nothing stands in its place
        want.append(None)
    texts += ["a story without any of it", "the software of the person is free and the notice above is a copy", ""]
    want += [None] * 3
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, label in enumerate(want):
        assert label is None or label in got[i].labels.split(",") and got[i].score >= licenses.SHARE, (texts[i], got[i])
        assert label is not None or got[i].labels == "", (texts[i], got[i])


# sharding


def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=50), st.integers(1, 300))
@settings(max_examples=40, deadline=None)
def test_jump_hash(keys, n):
    assert sharding.jump_hash(np.array(keys, np.int64), n).tolist() == [jump(k, n) for k in keys]


def test_shards(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == jump(r.doc_id or 0, 4) and r.grown_shard == jump(r.doc_id or 0, 5) and r.grown_shard in (r.shard, 4)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in document_rows())
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert sharding.shard(empty, 4).collect() == []


# URL filter


def test_url_rules_and_cascade(spark):
    hosts = [f"h{i}.site{i % 40}.example.org" for i in range(400)]
    listed = [f"site{i}.example.org" for i in range(0, 40, 3)] + ["never-seen.example"]
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://example.net/de/", "x://example.com/de/1", "x://example.com?q", "x://org/fr/", "x://a.b/c://d/e", "x://notnet/", "x://n.net"]
    urls += [f"https://{h}/p#f" for h in hosts]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame([(x,) for x in listed], "key string")).collect()}
    for i, url in enumerate(urls):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        rule = max((r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        verdict = rule[0] if rule else "block" if any(host == x or host.endswith("." + x) for x in listed) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule and rule[1] + rule[2], verdict), url
    none = spark.createDataFrame([], "key string")
    assert {r.verdict for r in url_filter.judge(pages.where("page_id > 12"), none).collect()} == {"allow"}
    assert url_filter.judge(pages.where("page_id < 0")).collect() == []


# substring dedup


def brute_removed(texts, size):
    split, seen = [words(t) for t in texts], Counter()
    for ws in split:
        seen.update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for ws in split:
        gone = {i + k for i in range(len(ws) - size + 1) if seen[tuple(ws[i : i + size])] > 1 for k in range(size)}
        out.append([w for i, w in enumerate(ws) if i not in gone])
    return out


def check_removed(spark, texts, size):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame, size).collect()}
    for i, kept in enumerate(brute_removed(texts, size)):
        line = " ".join(kept)
        assert (got[i].n_words, got[i].n_removed) == (len(words(texts[i])), len(words(texts[i])) - len(kept)), i
        assert got[i].kept_sha256 == hashlib.sha256(line.encode()).hexdigest() and got[i].kept_text == line


def test_substring_dedup(spark):
    random = np.random.default_rng(5)
    draw = lambda n, v: [f"w{x}" for x in random.integers(0, v, n)]
    passage, base = draw(60, 50), draw(200, 400)
    texts = [" ".join(draw(100, 30) + passage + draw(50, 30)) for _ in range(4)] + [" ".join(base), " ".join(base), " ".join(base[:90] + ["edit"] + base[91:])]
    texts += ["a " * 90, "a " * 36, "a " * 34, "a b " * 60, "x a b " + "a b " * 20 + "y", None, "", " ".join(passage[:35]), " ".join(passage[3:37])]
    texts += [" ".join(draw(30, 2) + ["z"] * k + draw(30, 2)) for k in (33, 34, 35, 36, 40)]
    check_removed(spark, texts, 35)


def test_substring_dedup_windows_share_symbols():
    """Equal windows get equal key symbols at equal distances, whatever stands around them."""
    random = np.random.default_rng(3)
    for vocabulary in (2, 3, 10, 1000):
        window = random.integers(0, vocabulary, 35)
        seen = set()
        for _ in range(200):
            names = K.mix(np.concatenate([random.integers(0, vocabulary, random.integers(0, 60)), window, random.integers(0, vocabulary, random.integers(0, 60))]).astype(np.uint64) + np.uint64(7))
            at = next(i for i in range(len(names)) if (names[i : i + 35] == K.mix(window.astype(np.uint64) + np.uint64(7))).all())
            place, name = substring_dedup.parse(names, np.zeros(len(names), int), np.array([at]), 35)
            seen.add((int(place[0]) - at if place[0] >= 0 else None, int(name[0])))
        assert len(seen) == 1


def test_substring_dedup_odd_rows(docs, empty):
    rows = substring_dedup.remove_repeats(docs).collect()
    assert len(rows) == len(document_rows())
    kept = brute_removed([r[1] for r in document_rows()], 35)
    want = sorted((-1 if r[0] is None else r[0], len(words(r[1])), len(words(r[1])) - len(k)) for r, k in zip(document_rows(), kept))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in rows) == want
    assert substring_dedup.remove_repeats(empty).collect() == []


def thue_morse(n, a="a", b="b"):
    """A word and its complement, equal under any polynomial hash modulo 2**64 with an odd base."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_break_polynomial_hashes_stay_apart(spark):
    for n in (64, 256, 257, 1024, 2048):
        one, other = thue_morse(n)
        shared = [f"s{i}" for i in range(34)]
        check_removed(spark, [" ".join([one, *shared]), " ".join([other, *shared]), " ".join([*shared, "x", one])], 35)
    lines = [thue_morse(2048, "p ", "q ")[i] for i in (0, 1)]  # the same, word by word
    check_removed(spark, [*lines, f"{lines[0][:400]} end"], 35)
    data = np.frombuffer(" ".join(w for n in (8, 9, 16, 250, 1024) for w in thue_morse(n)).encode(), np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    assert len(set(K.word_hashes(data, starts, ends).tolist())) == len(starts)


def test_removed_windows_are_the_same_however_words_are_spaced(spark):
    ws = [f"w{i % 29}x{i}" for i in range(50)]
    check_removed(spark, ["  ".join(ws), "\n".join(ws) + "\t", f"lead {' '.join(ws[:36])}"], 35)


# decontamination

ITEM = "A train leaves at 7 o'clock and travels 120 miles to Boston before Mary Smith boards it for another 3 hours. How far does the train go in all"


def test_decontamination(spark, docs, empty):
    filler = "some other words stand here and there without any meaning at all in this small document"
    moved = ITEM.replace("120", "450").replace("Boston", "Chicago").replace("Mary Smith", "John")
    texts = [f"{filler}. {ITEM}. {filler}", f"{filler}. {moved} {filler}", f"{filler} {ITEM[:40]} {filler}", filler, None, "", ITEM.upper(), ITEM.replace("train", "bus") + " " + ITEM.replace("7", "9")]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], "doc_id long, text string").withColumn("size", F.lit(1))
    items = spark.createDataFrame([(1, ITEM, 0), (2, "", 0), (3, None, 0), (4, "tiny item", 0)], "item_id long, text string, pos int")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(frame, items).collect()}
    assert {(0, 1), (1, 1), (7, 1), (None, 1)} <= set(got) and not {d for d, _ in got} & {2, 3, 4, 5}
    assert got[0, 1].exact and not got[1, 1].exact and got[0, 1].coverage >= 0.8
    joined = {(r.doc_id, r.item_id, r.n_covered) for r in decontamination.leaks(frame, items, max_filter=0).collect()}
    assert joined == {(d, i, r.n_covered) for (d, i), r in got.items()}
    clean = decontamination.keep_clean(frame, items)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in frame.collect() if r.doc_id is not None} - {d for d, _ in got})
    assert decontamination.leaks(docs, items.where("item_id > 9")).collect() == [] and decontamination.leaks(empty, items).collect() == []
    assert decontamination.keep_clean(docs, items).count() == len(document_rows())


def test_items_of_one_id(spark):
    """Items of one id and unlike texts are items of their own; an item that is given twice is one."""
    texts = ["the first question asks how many apples are in the basket", "another question wants the colour of the old barn door"]
    docs = spark.createDataFrame([(1, f"{texts[0]} {texts[1]}"), (2, texts[0])], "doc_id long, text string")
    items = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (7, texts[0])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()) == [(1, 7), (1, 7), (2, 7)]


def test_inconsistent_slots_do_not_match(spark):
    item = "take 5 apples and put 5 apples beside the basket then count all apples that lie beside 5 chairs"
    once = item.replace("5", "8")
    mixed = item.replace("put 5", "put 9")
    frame = spark.createDataFrame([(1, once), (2, mixed)], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.leaks(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


# language model


def brute_lm(rows):
    """(n_tokens, n_known, base score, score, held out, training tokens) of each row (id, text, ...)."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter()
    n3, n2, n1, n0 = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*words(lower(r[1])), None])
            s = [*lower(r[1]).encode(), 256]
            for k, x in enumerate(s):
                n0[x] += 1
                if k:
                    n1[s[k - 1]][x] += 1
                if k > 1:
                    n2[s[k - 2], s[k - 1]][x] += 1
                if k > 2:
                    n3[tuple(s[k - 3 : k])][x] += 1
    total, kinds = sum(counts.values()), len(counts)

    def p(contexts, x):
        ruled, left = set(), 1.0
        for n in contexts:
            n = {k: v for k, v in n.items() if k not in ruled}
            if n:
                if x in n:
                    return left * n[x] / (sum(n.values()) + len(n))
                left *= len(n) / (sum(n.values()) + len(n))
                ruled |= set(n)
        return left / (257 - len(ruled))

    want = []
    for r in rows:
        tokens, s = [*words(lower(r[1])), None], [*lower(r[1]).encode(), 256]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        score = sum(math.log10(p(([n3[tuple(s[k - 3 : k])]] if k > 2 else []) + ([n2[s[k - 2], s[k - 1]]] if k > 1 else []) + ([n1[s[k - 1]]] if k else []) + [n0], x)) for k, x in enumerate(s))
        want.append((len(tokens), sum(counts[t] > 0 for t in tokens), base, score, held(r[0]), total))
    return want


@pytest.mark.parametrize("max_cells", [40, lm_score.MAX_CELLS])
def test_lm_scores(docs, empty, max_cells):
    got = lm_score.score(docs, head=3, max_cells=max_cells).collect()  # most tokens take the join; few cells leave most contexts to the join
    want = brute_lm(document_rows())
    key = lambda r: (r[0], r[1], round(r[2], 3), round(r[3], 3), r[4])
    for r, w in zip(sorted(got, key=lambda r: key((r.n_tokens, r.n_known, r.base_score, r.score, r.held_out))), sorted(want, key=key)):
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (w[0], w[1], w[5], w[4])
        assert math.isclose(r.base_score, w[2], rel_tol=1e-9) and math.isclose(r.score, w[3], rel_tol=1e-6)
    assert lm_score.score(empty).collect() == []


def test_lm_does_not_take_one_word_for_another(spark):
    one, other = thue_morse(1024)
    docs = [(i, one if zlib.crc32(str(i).encode()) % 10 else other) for i in range(30)]
    assert {t for _, t in docs} == {one, other}
    got = lm_score.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.held_out, r.n_known) for r in got} == {(True, 1), (False, 2)}


# SimHash


def brute_fingerprint(text):
    ws = words(lower(text))
    if not ws:
        return 0
    hashes = [xxhash.xxh64(" ".join(ws[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
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


def test_near_duplicates(docs, empty):
    rows = document_rows()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    first = {c: min([r[0] for r, x in zip(rows, roots) if x == c and r[0] is not None], default=None) for c in roots}
    want = Counter((r[0], f"{f:016x}", first[c]) for r, f, c in zip(rows, fps, roots))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


@pytest.mark.parametrize("block, agree", [(16, 2), (1024, None), (64, 3), (1024, 4)])
def test_links_connect_chains_and_dense_groups(spark, block, agree):
    random = np.random.default_rng(9)
    fps = [int(x) for x in random.integers(0, 1 << 63, 60)]
    for start in fps[:3]:  # chains and dense groups
        at = start
        for _ in range(40):
            at ^= sum(1 << int(b) for b in random.choice(64, 4, replace=False))
            fps.append(at)
        fps += [start ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 64, (60, 2))]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    roots = brute_components(fps)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame, block=block, agree=agree)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for f, c in zip(signed, roots):
        groups[got.get(f, f)].add(f)
        want[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
