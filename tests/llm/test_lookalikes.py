from folioflow.llm.lookalikes import look_alike_keys, look_alike_pairs, printed_form, repaired, repairs

SCHEMA = "row_id bigint, path string, text string, section string, key string"


def pairs(spark, rows):
    keys = look_alike_keys(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    return sorted(tuple(r) for r in look_alike_pairs(keys).collect())


def test_printed_form():
    assert printed_form("é  x​­ Ａ！　ﬁ︎") == "é  xA! fi".replace("xA", "x A")
    same = "“a” ‘b’ — – ² ⑧ 𝐓 \t\r\n  A"
    assert printed_form(same) == same


def test_repairs_need_mixed_scripts_and_a_known_word():
    assert repairs("Τhe", "Latin") == ["The"]
    assert repairs("сосны", "Latin") == []
    assert repairs("cocны", "Latin") == ["сосны"]
    assert repaired("Τhe сосны", {"The"}) == "The сосны"
    assert repaired("Τhe", set()) == "Τhe"
    assert repaired("the А team", {"A"}) == "the A team"


def test_whole_tokens_of_look_alikes(spark):
    assert repairs("сор", "Latin") == ["cop"] and repairs("кот", "Latin") == [] and repairs("сор", "Cyrillic") == []
    rows = [(1, "p", "The сор ran to the door", ""), (2, "p", "The cop ran to the door", ""), (3, "p", "Это сор и кот", ""), (4, "q", "The сорх ran", "")]
    keys = look_alike_keys(spark.createDataFrame(rows, "row_id bigint, path string, text string, section string"))
    forms = {r.row_id: r.form for r in keys.where("form is not null and field = 'text'").collect()}
    assert forms[1] == "The cop ran to the door" and forms[3] == "Это сор и кот" and forms[4] == "The сорх ran"
    assert {tuple(r)[1:] for r in look_alike_pairs(keys).where("field = 'text'").collect()} == {(1, 2)}


def test_pairs(spark):
    rows = [
        (1, "p", "The door", "House > A"),
        (2, "q", "Τhe door", "Hоuse > A"),  # Greek Tau; Cyrillic o, but another path
        (3, "p", "The door", "Hоuse > A"),
        (3, "p", "The door", "Hоuse > A"),
        (4, "p", "the door", "house > A"),
        (5, "p", "The  door", None),
        (6, "p", None, ""),
        (7, None, "", "​"),
        (8, None, "​", ""),
        (9, "p", "The door", "House > A"),
    ]
    assert pairs(spark, rows) == [
        ("section", 1, 3), ("section", 3, 9), ("section", 7, 8),
        ("text", 1, 2), ("text", 1, 3), ("text", 2, 3), ("text", 2, 9), ("text", 3, 9), ("text", 7, 8),
    ]


def test_two_spellings_that_agree_need_no_clean_copy(spark):
    rows = [(1, "p", "Ζxоv", None), (2, "p", "Zxοv", None)]
    assert pairs(spark, rows) == [("text", 1, 2)]


def test_empty_and_very_long(spark):
    assert pairs(spark, []) == []
    long = "The door was cold. " * 20_000
    assert pairs(spark, [(1, "p", long, ""), (2, "p", long.replace("e", "е"), "")]) == [("text", 1, 2)]


def test_hot_key_pairs_different_spellings_only(spark):
    rows = [(i, "p", "The door", None) for i in range(300)] + [(900, "p", "The door", None), (901, "p", "T​he door", None)]
    found = pairs(spark, rows)
    assert len(found) == 601 and len(set(found)) == 601 and ("text", 900, 901) in found
