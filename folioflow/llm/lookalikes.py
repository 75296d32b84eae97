"""One consistent form for text that looks the same but differs in its characters."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.runtime import cut, spread

#: Letters of other scripts that print like a Latin letter, and Latin look-alikes (fixed values).
#: Marks are looked at apart from their letters, so accented letters need no entries.
LOOK_ALIKES = {
    "Cyrillic": dict(zip("аеорсухіѕјһԁԛԝѵӏАВЕКМНОРСТУХЅІЈԌԚԜ", "aeopcyxisjhdqwvlABEKMHOPCTYXSIJGQW", strict=True)),
    "Greek": dict(zip("οϲνΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ocvABEZHIKMNOPTYXCj", strict=True)),
    "Armenian": dict(zip("օսհոցՕՏԼ", "ouhngOSL", strict=True)),
    "Latin": dict(zip("ɑɡı", "agi", strict=True)),
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: Texts without any of these characters, and in composed form, are in their final form already.
_ODD = regex.compile(
    r"[\p{Cf}\p{M}\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}ɑɡı\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
    r"\u00a0\u115f\u1160\u1680\u2000-\u200a\u202f\u205f\u3000\u3164\ufb00-\ufb06\uff01-\uff5e\uffa0\uffe0-\uffe6]"
)
_NOTHING = regex.compile(r"[\p{Cf}\ufe00-\ufe0f\U000e0100-\U000e01ef\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180e\u3164\uffa0\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]+")
_BLANK = regex.compile(r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict(zip(range(0xFFE0, 0xFFE7), "¢£¬¯¦¥₩")) | {ord(k): v for k, v in LIGATURES.items()}
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_MIXABLE = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}ɑɡı]")
_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in LOOK_ALIKES}
_TO_LATIN = {c: latin for table in LOOK_ALIKES.values() for c, latin in table.items()}
#: For each script, what its look-alikes of other scripts become.
_INTO = {"Latin": _TO_LATIN}
for _name, _table in LOOK_ALIKES.items():
    if _name != "Latin":
        _back = {latin: c for c, latin in reversed(_table.items())}
        _INTO[_name] = _back | {c: _back[latin] for c, latin in _TO_LATIN.items() if latin in _back and c not in _table}


def printed_form(text: str) -> str:
    """Composed, without characters that print nothing, with plain blanks and ordinary-width letters."""
    text = unicodedata.normalize("NFC", _NOTHING.sub("", _BLANK.sub(" ", text)).translate(_WIDE))
    return _NOTHING.sub("", text)


def script_of(letter: str) -> str | None:
    for name, pattern in _SCRIPTS.items():
        if pattern.match(letter):
            return name
    return None


def repairs(token: str, around: str) -> list[str]:
    """What a token of mixed scripts might have been meant as, the likeliest first.

    A token that can be read wholly in ``around``, the script of the text about it, is so read first;
    else in its own scripts, the one of most of its letters first. A token of one script that holds
    any letter without a look-alike is left alone.
    """
    letters = unicodedata.normalize("NFD", token)
    counts = Counter(s for c in letters if (s := script_of(c)))
    if not counts:
        return []
    odd = "Latin" in counts and any(c in LOOK_ALIKES["Latin"] for c in letters)
    if len(counts) == 1 and not odd and next(iter(counts)) == around:
        return []
    out = []
    for script in sorted({*counts, around} & set(_INTO), key=lambda s: (s != around, -counts[s], s)):
        table = _INTO[script]
        changed = "".join(table.get(c, c) for c in letters)
        own = {s for c in changed if (s := script_of(c))}
        form = unicodedata.normalize("NFC", changed)
        if own == {script} and form != token and form not in out:
            out.append(form)
    return out


def _around(text: str) -> str:
    """The script of most letters that can't be taken for another script's; Latin if there are none."""
    counts = {name: sum(c not in LOOK_ALIKES[name] for c in pattern.findall(text)) for name, pattern in _SCRIPTS.items()}
    return max(counts, key=lambda s: (counts[s], s == "Latin"))


def repaired(text: str, allowed: frozenset[str] | set[str]) -> str:
    """``text`` (a printed form) with each token's likeliest repair that is among ``allowed``."""
    if not _MIXABLE.search(text):
        return text
    around = _around(text)

    def one(m: regex.Match) -> str:
        token = m[0]
        if _MIXABLE.search(token):
            for form in repairs(token, around):
                if form in allowed:
                    return form
        return token

    return _TOKEN.sub(one, text)


def _digest(*parts: str) -> bytes:
    return hashlib.md5("\0".join(parts).encode("utf-8", "surrogatepass")).digest()


_SCAN = "kind string, field string, row_key binary, row_id bigint, raw binary, form string, parts array<string>"


def _scan(rows: DataFrame) -> DataFrame:
    """One pass over (row_id, path, text, section): what the later steps need, and no clean text.

    kind ``plain``: a string already in its final form, with its hash only; ``odd``: its printed form
    and the repairs its tokens might need; ``word``: a word of the corpus, once for each batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            out = []
            words: set[str] = set()
            for field, values, scopes in (("text", batch.text, None), ("section", batch.section, batch.path)):
                known: dict[tuple[str, str], tuple] = {}
                for i, (row_id, value) in enumerate(zip(batch.row_id, values)):
                    if value is None:
                        continue
                    scope = "" if scopes is None else (scopes.iat[i] or "")
                    found = known.get((value, scope))
                    if found is None:
                        raw = _digest(scope, value)
                        if not _ODD.search(value) and unicodedata.is_normalized("NFC", value):
                            found = ("plain", raw, None, None)
                            words.update(_TOKEN.findall(value))
                        else:
                            form = printed_form(value)
                            options: set[str] = set()
                            around = _around(form)
                            for token in set(_TOKEN.findall(form)):
                                options.update(choices := repairs(token, around) if _MIXABLE.search(token) else [])
                                if not choices:
                                    words.add(token)
                            found = ("odd", raw, form, sorted(options))
                        known[value, scope] = found
                    kind, raw, form, options = found
                    out.append((kind, field, scope.encode("utf-8", "surrogatepass"), row_id, raw, form, options))
            if len(seen) > 500_000:
                seen = set()
            words -= seen
            seen |= words
            out.extend(("word", None, None, None, None, w, None) for w in words)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCAN.split(", ")])

    return rows.mapInPandas(run, _SCAN)


def look_alike_keys(passages: DataFrame, row_id: str = "row_id", path: str = "path", text: str = "text", section: str = "section") -> DataFrame:
    """``field, row_id, raw binary, key binary, form`` of every non-null text and section.

    Two strings look the same exactly if their ``key`` is equal; sections only count within one path,
    so their keys hold it. ``form`` is the one consistent form, null where the string already has it
    (its ``raw`` and ``key`` are then equal).

    The printed form is canonical composition without characters that print nothing, with plain
    blanks and ordinary-width letters; case, accents, the number of blanks, tabs, line ends, quotes,
    dashes and styled letters stay as they are. Then look-alike letters are replaced script by
    script. In a token that mixes scripts they are replaced towards its dominant script, or that of the text about it if
    the whole token can be read in it, where the result is a word of the corpus. Two further steps go beyond
    that rule, since whole words are written in look-alikes too: a token wholly in another script than the text about it
    is also replaced, if every letter of it has a look-alike (``сор`` within Latin text, where ``cop`` is a word; not
    ``кот``, which has none for ``т``, nor any word of a text in its own script); and a result that two or more
    different spellings agree on needs not be a word of the corpus.

    Only strings with odd characters are shuffled with their text; all others travel as two hashes.
    The vocabulary is a distinct aggregate, and reaches the odd strings by a join on their candidate
    words, so nothing is collected or broadcast. Empty strings are ordinary strings.
    """
    rows = spread(passages.select(F.col(row_id).alias("row_id"), F.col(path).alias("path"), F.col(text).alias("text"), F.col(section).alias("section")))
    scanned = cut(_scan(rows))
    odd = scanned.where("kind = 'odd'").select("field", "row_key", "row_id", "raw", "form", "parts")
    distinct_odd = odd.groupBy("field", "raw").agg(F.first("row_key").alias("row_key"), F.first("form").alias("form"), F.first("parts").alias("parts"))
    asked = distinct_odd.select("field", "raw", F.explode("parts").alias("word"))
    vocabulary = scanned.where("kind = 'word'").select(F.col("form").alias("word")).distinct()
    agreed = asked.groupBy("word").agg(F.count_distinct("raw").alias("n")).where("n > 1").select("word")
    known = asked.select("word").distinct().join(vocabulary.unionByName(agreed).distinct(), "word")
    allowed = asked.join(known, "word").groupBy("field", "raw").agg(F.collect_set("word").alias("allowed"))
    work = distinct_odd.join(allowed, ["field", "raw"], "left").select("field", "raw", "row_key", "form", "allowed")

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [repaired(form, set(ok) if ok is not None else set()) for form, ok in zip(batch.form, batch.allowed)]
            keys = [_digest(bytes(scope).decode("utf-8", "surrogatepass"), form) for scope, form in zip(batch.row_key, forms)]
            yield pd.DataFrame({"field": batch.field, "raw": batch.raw, "key": keys, "form": forms})

    # Needed by every reader of the keys; no more rows than there are different odd strings.
    fixed = cut(work.mapInPandas(fix, "field string, raw binary, key binary, form string"))
    odd_rows = odd.select("field", "row_id", "raw").join(fixed, ["field", "raw"])
    plain = scanned.where("kind = 'plain'").select("field", "row_id", "raw", F.col("raw").alias("key"), F.lit(None).cast("string").alias("form"))
    return plain.unionByName(odd_rows.select("field", "row_id", "raw", "key", "form"))


def look_alike_pairs(keys: DataFrame) -> DataFrame:
    """``field, row_id_a, row_id_b``: rows whose strings look the same but are not the same string.

    Only keys that two or more different strings share are looked at further: they are found by an
    aggregate over (field, key, raw), so that equal strings, however many, are counted before they are
    shuffled. Pairs are formed of different spellings, once each, and only then spelt out by rows: rows
    of equal strings are never compared, and the work is that of writing the result.
    """
    spellings = keys.groupBy("field", "key", "raw").agg(F.count(F.lit(1)).alias("n"))
    varied = cut(spellings.groupBy("field", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("field", "key"))
    rows = cut(keys.join(varied, ["field", "key"]).select("field", "key", "raw", "row_id").distinct())
    ways = rows.select("field", "key", "raw").distinct()
    one = ways.withColumnRenamed("raw", "raw_a")
    other = ways.withColumnRenamed("raw", "raw_b")
    different = one.join(other, ["field", "key"]).where("raw_a < raw_b")
    a = rows.select("field", "key", F.col("raw").alias("raw_a"), F.col("row_id").alias("a"))
    b = rows.select("field", "key", F.col("raw").alias("raw_b"), F.col("row_id").alias("b"))
    spelt = different.join(a, ["field", "key", "raw_a"]).join(b, ["field", "key", "raw_b"]).where("a <> b")
    return spelt.select("field", F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b")).distinct()
