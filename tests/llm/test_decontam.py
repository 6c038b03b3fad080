import random

import pytest

from sourcewell.llm import decontam
from sourcewell.llm.decontam import leaks

ITEM = "Yesterday Maria bought 12 apples and 5 kg of flour, then she gave 12 apples to Pedro because he was hungry."


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(1)
    words = "river stone walk bright sudden carry over under bread night open window letter garden".split()
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    items = [(1, ITEM), (2, " ".join(f"w{rng.randint(0, 10**6)}x" for _ in range(40))), (3, "tiny item here"), (4, None), (5, ""), (6, "10 20 30 40 50 60 70 80 90 100")]
    reworded = ITEM.replace("12", "31").replace("Maria", "Hannah").replace("Pedro", "Otto").replace("kg", "lb")
    broken = ITEM.replace("12 apples and", "31 apples and").replace("Pedro", "Maria")
    docs = [
        (1, prose(200) + " " + ITEM + " " + prose(100)),
        (2, prose(50) + " " + reworded + " " + prose(9)),
        (3, prose(20) + " " + broken),
        (4, prose(500)), (5, None), (6, ""), (7, "!!! ??"),
        (8, items[1][1].upper()),
        (9, " ".join(items[1][1].split()[:30])),
        (10, " ".join(items[1][1].split()[:12])),
        (11, "see tiny, item HERE"),
        (12, "x " + items[5][1]), (13, "1 2 3 4 5 6 7 8 9 10"),
        (14, ITEM + " " + prose(20) + " " + reworded),
        (1, prose(10)), (15, prose(3000) + " " + ITEM),
    ]
    got = leaks(spark.createDataFrame([(*d, 0, "") for d in docs], "doc_id long, text string, item_id int, h string"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int"))
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def test_pairs(found):
    assert set(found) == {(1, 1), (2, 1), (8, 2), (9, 2), (11, 3), (12, 6), (14, 1), (15, 1)}


def test_kinds_and_coverage(found):
    assert found[1, 1].verbatim and found[1, 1].coverage == 1
    assert not found[2, 1].verbatim and found[2, 1].coverage == 1
    assert found[14, 1].verbatim
    assert 0.6 < found[9, 2].coverage < 0.8


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaks(docs.limit(0), items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0
    assert leaks(docs, items).count() == 1


def test_inserted_and_missing_words_and_longer_fillers(spark):
    long = " ".join(f"v{i}q" for i in range(37))
    w = long.split()
    docs = [
        (1, " ".join(["so", *w[:18], "new", *w[18:], "end"])), (2, " ".join([*w[:18], *w[19:]])),
        (3, " ".join([*w[:12], "new", *w[12:25], *w[26:]])), (4, " ".join(w[:9]) + " and then " + " ".join(w[20:28])),
        (5, ITEM.replace("Maria", "Mary Ann").replace("5 kg", "5kg").replace("Pedro", "Karl Otto")), (6, ITEM.replace("12", "1 000")),
        (7, ITEM.replace("12", "5").replace("5 kg", "5 lb")), (8, ITEM.replace("12 apples and", "31 apples and")),
    ]
    items = spark.createDataFrame([(1, ITEM), (2, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 2), (2, 2), (3, 2), (5, 1), (6, 1), (7, 1)}
    assert got[1, 2].coverage == 1 and 0.9 < got[2, 2].coverage < 1 and got[1, 2].verbatim and got[5, 1].coverage == 1


def brute(docs, items):
    """Every window of every document against every window of every item, without bitmap or join."""
    out = set()
    for item, text in items:
        (words, own, places, hashes, slot), = decontam.template([text])
        width = min(decontam.WINDOW, len(hashes))
        grams = decontam.windows(hashes, width)
        literal = [int((~slot[i : i + width]).sum()) for i in range(len(grams))]
        kept, least = [i for i, n in enumerate(literal) if n >= width / 2], 0.5
        if not kept:
            kept, least = [i for i, n in enumerate(literal) if n >= 2], 0.9
        if not kept:
            continue
        held = len({i + k for i in kept for k in range(width)})
        for doc, body in docs:
            (words2, _, places2, hashes2, slot2), = decontam.template([body])
            theirs = decontam.windows(hashes2, width)
            hits = [
                {"start": j, "pos": i, "own": decontam._edges(decontam._slots(words, places, slot, i, width), not i and slot[0], i == len(grams) - 1 and slot[-1]), "slots": decontam._slots(words2, places2, slot2, j, width)}
                for i in kept for j in range(len(theirs)) if grams[i] == theirs[j]
            ]
            if hits and decontam.occurrence(hits, width, len(kept), held, least):
                out.add((doc, item))
    return out


def test_reparameterised_items_against_brute_force(spark):
    """All numbers and names changed: every item is met again, those that are mostly slots too, as brute force says."""
    rng = random.Random(3)
    names = ["Maria", "Hannah", "Pedro", "Otto", "Akira", "Lena", "Tomas", "Wei"]
    verbs, things = ["bought", "sold", "carried", "counted", "gave away", "lost"], ["apples", "bricks", "letters", "coins", "lamps"]

    def question(kind, a, b, c, n1, n2):
        if kind % 3 == 0:  # mostly slots
            return f"{a} {n1} and {b} {n2} and {c} {n1} or {b} {n1} and {a} {n2} and {c} {n2} or {a} {n1}"
        shape = random.Random(kind)
        v, w, x, y = shape.choice(verbs), shape.choice(verbs), shape.choice(things), shape.choice(things)
        return f"On monday {a} {v} {n1} {x} and {n2} {y} while {b} {w} only {n2} {x}, so how many {y} has {c} got after {a} {v} {n1} {x} number {kind}x"

    items, docs = [], []
    for i in range(45):
        first, second = rng.sample(names, 3), rng.sample(names, 3)
        items.append((i, question(i, *first, rng.randint(2, 99), rng.randint(100, 999))))
        noise = " ".join(rng.choices(["river", "stone", "walk", "bright", "under", "bread"], k=rng.randint(5, 60)))
        docs.append((i, f"{noise}. " + question(i, *second, rng.randint(2, 99), rng.randint(100, 999)) + f". {noise}"))
        docs.append((1000 + i, noise + " " + " ".join(f"{rng.choice(names)} {rng.randint(2, 99)}" for _ in range(9))))
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)
    assert sum((i, i) in got for i in range(45)) >= 43
    assert all(d < 1000 for d, _ in got)


def plain(text):
    """Words of a text by a rule of its own: number, name or the word itself; written without the module."""
    out = []
    for word in text.split():
        bare = word.strip(".,?!;:'\"()")
        if bare:
            out.append(("N", bare) if bare.isdigit() else ("P", bare) if bare.istitle() and bare not in STARTERS else ("w", bare.lower()))
    return out


STARTERS = {"How", "If", "She", "He", "They", "After", "Then", "The", "When", "What"}


def holds(doc, item):
    """Whether the whole item is somewhere in the document, each of its fillers standing for one filler there."""
    a, b = plain(doc), plain(item)
    for i in range(len(a) - len(b) + 1):
        table = {}
        if all(x[0] == y[0] and (table.setdefault(y[1], x[1]) == x[1] if y[0] != "w" else x[1] == y[1]) for x, y in zip(a[i:], b, strict=False)):
            return True
    return False


def story(shape, names, numbers):
    """A word problem of several sentences, most of which begin with a name."""
    rng = random.Random(shape)
    a, b, c = names
    x, y, z = numbers
    t, u = rng.sample(["apples", "marbles", "stickers", "books", "shells", "pencils", "cards", "ribbons", "coins", "stamps"], 2)
    v = rng.sample(["buys", "finds", "collects", "packs", "draws", "counts"], 3)
    place = rng.choice(["market", "school", "harbour", "library", "garden", "station", "museum", "bakery"])
    day = rng.choice(["rainy", "quiet", "busy", "windy", "cold", "sunny"])
    return rng.choice([
        f"{a} {v[0]} {x} {t}. {a} gives {y} {t} to {b}. {c} {v[1]} {z} {u} at the {place} on a {day} day. How many {t} does {a} have left now?",
        f"{a} has {x} {t} in a {day} box. {b} {v[0]} {y} more {t} near the {place}. {b} then hands {z} of them to {a}. How many {t} has {b} got in the end?",
        f"At the {place} {a} {v[0]} {x} {t}. {b} {v[1]} {y} {u} and {z} {t}. {c} wants all of the {day} {t}. What must {c} pay {a} for them?",
        f"{a} and {b} walk to the {place}. {a} {v[0]} {x} {t}. {b} {v[2]} {y} {u}. {c} takes {z} {u} away. When they come home, how many {u} are left?",
    ])


FIRST = "Maria Elena Peter Tom Akira Lena Hannah Otto Pedro Wei Ines Karl Priya Omar".split()


def test_stories_of_several_sentences(spark):
    rng = random.Random(6)
    noise = lambda: " ".join(rng.choices(["river", "stone", "walk", "bright", "under", "bread", "open"], k=rng.randint(3, 50)))
    fill = lambda: (rng.sample(FIRST, 3), rng.sample(range(2, 99), 3))
    items = [(i, story(i, *fill())) for i in range(200)]
    docs = [(i, f"{noise()}{rng.choice(['.', '', ':'])} {story(i, *fill())} {noise()}") for i in range(200)]
    docs += [(1000 + i, noise() + ". " + " ".join(f"{rng.choice(FIRST)} has {rng.randint(2, 99)} things." for _ in range(6))) for i in range(50)]
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in got for i in range(200)) >= 190
    whole = {(d, i) for d, body in docs for i, text in items if holds(body, text)}
    assert len(whole) >= 150 and len(whole - got) <= len(whole) // 50
    assert all(d < 1000 for d, _ in got)


def test_names_that_begin_sentences(spark):
    items = [(1, "Maria has 12 apples. Maria gives 5 apples to Tom. Tom eats 2 apples."), (2, "Otto lost 4 keys. Hannah found 3 keys. Otto paid Hannah 6 coins.")]
    docs = [(1, "So: Elena has 7 apples. Elena gives 3 apples to Peter. Peter eats 1 apples."), (2, "Wei lost 9 keys. Ines found 8 keys. Wei paid Ines 2 coins."), (3, "Wei lost 9 keys. Ines found 8 keys. Omar paid Wei 2 coins.")]
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(1, 1), (2, 2)} <= got


def test_names_beside_an_item(spark):
    item = "Maria has 12 apples in the old garden. Maria gives 5 of those apples to Tom."
    docs = [(1, "said Karl " + item + " Wei left."), (2, item.replace("Maria", "Elena").replace("Tom", "Otto")[:-1] + " Wei left"), (3, "said Karl " + item.replace("Maria", "Elena").replace("12", "9")), (4, "said Karl " + item.replace("Maria has", "Elena has"))]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), min_coverage=0.99).collect()
    assert {(r.doc_id, r.verbatim) for r in got} == {(1, True), (2, False), (3, False)}
