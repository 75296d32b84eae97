import random

from folioflow.llm.leakage import ItemIndex, leaked_items, reader_words, spaced, within_edits


def brute(docs, items, words=12):
    out = set()
    for d, text in docs:
        body = spaced(reader_words(text))
        for i, item in items:
            w = reader_words(item)
            n = min(words, len(w))
            if w and any(spaced(w[k : k + n]) in body for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def verbatim(spark, docs, items):
    docs = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    rows = [tuple(r) for r in leaked_items(docs, items).where("edits = 0").select("doc_id", "item_id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_words_as_seen():
    assert reader_words("The *co­ld*\n_Zoë_​ Ｄoor, it's") == ["the", "cold", "zoë", "door", "it", "s"]
    assert reader_words(None) == reader_words("") == reader_words(" *** ") == []


def test_banded_distance():
    for a, b, e in (("abcdef", "xabcdefx", 0), ("abcdef", "xabcefxx", 1), ("abcdef", "xabzcdefx", 1), ("abcdef", "xazzdefx", 2)):
        assert min(2, within_edits(a, b, 1, 1)) == e


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "nobody", "in", "had", "so", "cold", "a", "door", "été", "lamp", "9"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 8, 12, 13, 40, 90])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "—"), (0, items[0][1]), (103, items[5][1])]
    docs = []
    for d in range(150):
        words = rng.choices(vocabulary, k=rng.choice([5, 60, 300]))
        item = reader_words(items[rng.randrange(40)][1])
        start = rng.randrange(len(item))
        part = item[start : start + rng.choice([3, 11, 12, 20, 90])]
        at = rng.randrange(len(words))
        docs.append((d, rng.choice([" ", "\n", "  "]).join(words[:at] + [w.upper() if rng.random() < 0.1 else w for w in part] + words[at:])))
    docs += [(900, None), (901, ""), (902, "*"), (0, docs[0][1]), (903, " ".join(rng.choices(vocabulary, k=400_000)) + " " + items[5][1])]
    assert verbatim(spark, docs, items) == brute(docs, items)


def test_passes_and_stretches_change_nothing(spark, monkeypatch):
    from folioflow.llm import leakage

    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([4, 15, 30])))) for i in range(12)]
    docs = []
    for d in range(20):
        words = rng.choices(vocabulary, k=400)
        part = reader_words(items[rng.randrange(12)][1])
        at = rng.randrange(400)
        docs.append((d, " ".join(words[:at] + part + words[at:])))
    monkeypatch.setattr(leakage, "AT_ONCE", 300)
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 400)
    assert verbatim(spark, docs, items) == brute(docs, items)


def test_one_edit(spark):
    item = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    docs = [(1, item), (2, "x " + item.replace("jumps", "jumped", 1).replace("jumped", "jumpz")), (3, item.replace("jumps", "leapt"))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {tuple(r) for r in leaked_items(d, i).collect()} == {(1, 7, 0), (2, 7, 1)}


def test_empty_tables(spark):
    assert verbatim(spark, [], [(1, "a b c")]) == verbatim(spark, [(1, "a b c")], []) == set()


def test_long_stretch_boundaries():
    index = ItemIndex.build([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], 12, 1)
    assert index.leaks([spaced(["x"] * 50 + reader_words(index.texts[0])[1:] + ["y"])]) == [(0, 1, 0)]


def distance(a, b):
    """The least edit distance of ``a`` to any stretch of ``b``, by the whole table."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        after = [i]
        for j, d in enumerate(b, 1):
            after.append(min(row[j] + 1, after[j - 1] + 1, row[j - 1] + (c != d)))
        row = after
    return min(row)


def test_revised_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 6, 9])))) for i in range(8)]
    docs = []
    for d in range(60):
        body = rng.choices(words, k=30)
        part = rng.choice(items)[1].split()
        k = min(6, len(part))
        at = rng.randrange(len(part) - k + 1)
        held = " ".join(part[at : at + k])
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            x = rng.randrange(len(held))
            held = rng.choice([held[:x] + "z" + held[x + 1 :], held[:x] + held[x + 1 :], held[:x] + "z" + held[x:]])
        place = rng.choice([0, 10, 30])
        docs.append((d, " ".join([*body[:place], held, *body[place:]])))
    expected = {}
    for d, body in docs:
        form = spaced(reader_words(body))
        for i, text in items:
            w = reader_words(text)
            k = min(6, len(w))
            best = min(distance(spaced(w[n : n + k]), form) for n in range(len(w) - k + 1))
            if best <= 1:
                expected[d, i] = best
    df = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in leaked_items(*df, words=6).collect()}
    assert {0, 1} <= set(expected.values()) and found == expected
