"""Leaks that a brute force over single alignments, without sessions, demands."""

import brute
from arbalest.llm import decontamination

TEMPLATE = "Tom has 3 red apples and then Ann has 5 red apples and then Sue has 7 red apples."
SHORT = "What is 5 times 3 plus two?"


def demanded(docs, items):
    """(doc_id, item_id) where one alignment alone covers enough with slots that agree."""
    out = set()
    for i, item in items:
        want = brute.template(item)
        size = min(decontamination.WIDTH, len(want))
        for d, doc in docs:
            got = brute.template(doc)
            for shift in range(-len(want), len(got)):
                covered, values = set(), {}
                fits = True
                for at in range(len(want) - size + 1):
                    a, b = want[at : at + size], got[at + shift : at + shift + size] if at + shift >= 0 else []
                    plain = sum(kind == "plain" for kind, _, _ in a)
                    if len(b) == size and [t[:2] for t in a] == [t[:2] for t in b] and plain >= (decontamination.PLAIN if size == decontamination.WIDTH else 1):
                        covered |= set(range(at, at + size))
                        fits &= all(values.setdefault(x[2], y[2]) == y[2] for x, y in zip(a, b) if x[2])
                if fits and len(covered) >= decontamination.COVER * len(want):
                    out.add((d, i))
    return out


def found(spark, docs, items):
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontamination.leaks(*frames).collect()}


def test_repeated_templates_and_copies_in_a_row(spark):
    same = "So Tom sold 3 red apples at noon, then Tom sold 3 green pears at night, then Tom sold 3 old hats"
    items = [(1, TEMPLATE), (2, SHORT), (3, same)]
    moved = TEMPLATE.replace("Ann", "Bob").replace("3", "11").replace("7", "12")
    docs = [
        (1, TEMPLATE), (2, f"some words before it: {moved}"), (3, "What is 5 times 3 plus two? What is 8 times 4 plus six? What is 9 times 7 plus one?"),
        (4, "What is 5 times 5 plus two? What is 8 times 4 plus 4"), (5, same.replace("3 green", "4 green").replace("3 old", "5 old")),
        (6, TEMPLATE.replace("then Ann", "then surely Ann")), (7, "nothing of the kind is written here"),
    ]
    got, want = found(spark, docs, items), demanded(docs, items)
    assert want >= {(1, 1), (2, 1), (3, 2)} and want <= set(got)
    assert got[1, 1].exact and got[1, 1].n_covered == got[1, 1].n_tokens and not got[2, 1].exact
    assert (6, 1) in got  # one word more inside: two alignments, among those of the repeats
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (6, 1)}


def test_verbatim_copies_of_items_poor_in_plain_words(spark):
    items = [(1, "Compute 12 + 30 - 5 * 6 and 7 8 9 in 3 steps"), (2, "What is 12 + 30 - 5 * 6 ?"), (3, "17 4 2028 6 11 5"), (4, "31 77"), (5, "so 3 km and 4 kg or 5 lb and 6 oz")]
    docs = [(i, f"some words come first. {text} And some follow.") for i, text in items]
    docs += [(11, "What is 12 + 31 - 5 * 6 ?"), (12, "17 4 2029 6 11 5"), (13, "77 31"), (14, "so 3 km and 4 kg or 5 lb and 7 oz")]
    got = found(spark, docs, items)
    assert {k for k in got if k[0] < 10} == {(i, i) for i, _ in items} and all(got[i, i].exact and got[i, i].n_covered == got[i, i].n_tokens for i, _ in items)
    assert not {(11, 2), (12, 3), (13, 4)} & set(got)


def test_names_in_other_scripts(spark):
    item = "вчера Иван купил 3 яблока и потом Иван отдал 2 яблока а Ζωή и Đorđe взяли 4 яблока домой"
    moved = item.replace("Иван", "Олег Петров").replace("3", "9").replace("Ζωή", "Άννα").replace("Đorđe", "Šime")
    docs = [(1, f"начало текста. {moved} и конец"), (2, item), (3, item.replace("потом Иван", "потом Олег")), (4, item.upper())]
    got = found(spark, docs, [(1, item)])
    assert set(got) == {(1, 1), (2, 1)} and not got[1, 1].exact and got[2, 1].exact


def test_names_that_open_sentences(spark):
    items = [(1, "Tom has 3 apples. Ann has 5 apples. Who has more?"), (2, "Yesterday it rained. Mary Jones walked 4 miles to school. Then she walked home. Mary Jones was wet")]
    docs = [
        (1, "Bob has 4 apples. Eve has 6 apples. Who has more?"), (2, "Intro words. Yesterday it rained. Carl walked 7 miles to school. Then she walked home. Carl was wet"),
        (3, "Zoe has 4 apples. Bob Hill has 6 apples. Who has more?"), (4, "Yesterday it rained. Carl walked 7 miles to school. Then she walked home. Anna was wet and so was Carl"),
        (5, items[0][1].lower()),
    ]
    got = found(spark, docs, items)
    assert set(got) >= {(1, 1), (2, 2), (3, 1), (5, 1)} and not got[1, 1].exact and got[5, 1].exact
    assert not {(1, 2), (2, 1), (5, 2)} & set(got)


def test_a_search_of_many_ways_ends():
    """Runs of one template in item and document, whose slots never agree: every way to the same hit and slots is tried once."""
    hits = [(40, 5 * a, 5 * b, 5, (1,), (2,)) for a in range(8) for b in range(8)]
    hits = [h[1:] for h in hits]
    got = decontamination._chain(hits, 40, 32.0)
    assert got is None or len(got) >= 1
