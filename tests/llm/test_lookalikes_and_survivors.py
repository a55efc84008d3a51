"""Look-alike names and surviving records against brute force."""

import datetime as dt
import os
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.functions.paths import page_key
from lorespark.functions.versions import version_key
from lorespark.llm import queries as q
from lorespark.llm.lookalikes import Trie, canonical_names, cut_words, fold, lookalike_pairs, walk_words
from lorespark.llm.survivors import filled_count, survivors

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
GROUPS = [
    ["Документ.Ёлка", " Дoкyмeнт．Ёлка ", "Доку​мент.\xadЁлка﻿"],
    ["ДокумЕнт.Ёлка"], ["Документ.Елка"], ["Документ. Ёлка", "Документ.　Ёлка", "Документ.\xa0Ёлка"],
    ["COM", "СОМ", "ＣＯＭ"], ["Com"], ["COM1", "СОМ１"], ["COM2"], ["", " ", "​\xa0"], ["Façade", "Façade"], ["Facade"], ["XMLКаталог", "ХМLКаталoг"],
]


def test_fold_and_words():
    forms = [{fold(n) for n in g} for g in GROUPS]
    assert all(len(f) == 1 for f in forms) and len(set().union(*forms)) == len(GROUPS)
    for g in GROUPS:
        assert len({tuple(fold(w) for _, w in cut_words(n) if fold(w)) for n in g}) == 1
        assert all("".join(w for _, w in cut_words(n)) for n in g if n)
    assert [w for _, w in cut_words("XMLКаталогЧасть505.Слой")] == ["XML", "Каталог", "Часть", "505", ".", "Слой"]


def test_trie():
    t = Trie()
    for w, n in (("Каталог", 5), ("Kaталог", 1), ("Слой", 3), ("Слои", 9)):
        t.add(w, n)
    assert t.walk("К​aтaлoг")[0][2] == "Каталог" and t.walk("Слой")[0][2] == "Слой"
    assert t.walk("Каталк") == [] and t.walk("Слоя") == [] and {w for _, _, w in t.walk("Слоя", 1)} == {"Слои"}


VARIANTS = {
    "cyrillic": lambda n: n.translate(str.maketrans("acopexAKMT", "асорехАКМТ")), "greek": lambda n: n.translate(str.maketrans("ovpAKMT", "ονρΑΚΜΤ")), "wide": lambda n: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in n),
    "bold": lambda n: "".join(chr(0x1D400 + ord(c) - 65) if "A" <= c <= "Z" else chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in n), "sans": lambda n: "".join(chr(0x1D5A0 + ord(c) - 65) if "A" <= c <= "Z" else c for c in n),
    "composed": lambda n: unicodedata.normalize("NFC", n), "decomposed": lambda n: unicodedata.normalize("NFD", n), "zero width": lambda n: "\u200b".join(n), "joiners": lambda n: n.replace("a", "a\u200d").replace("o", "\u2060o"),
    "soft hyphen": lambda n: n[:2] + "\xad" + n[2:], "selectors": lambda n: n + "\ufe0f", "blanks": lambda n: n.replace(" ", "\u2003"), "no-break": lambda n: n.replace(" ", "\xa0"), "ends": lambda n: f"\u3000{n} ",
    "ligature": lambda n: n.replace("fi", "\ufb01"), "cherokee": lambda n: n.translate(str.maketrans("ATM", "ᎪᎢᎷ")), "lisu": lambda n: n.translate(str.maketrans("KTM", "ꓗꓔꓟ")), "armenian": lambda n: n.replace("o", "օ"), "roman": lambda n: n.replace("IV", "Ⅳ"),
}


def test_recall_of_variants(spark):
    names = ["Config Table", "AccountMap", "Façade Module IV", "Kopie vom Auftrag", "Toolbox", "Товар Учёт", "Map2Export", "fine path"]
    made = [(n, v, f(n)) for n in names for v, f in VARIANTS.items()]
    forms = {r.name: r.canon for r in canonical_names(spark.createDataFrame([(n,) for n in {*names, *(x for _, _, x in made)}], "name string")).collect()}
    missed = [(n, v) for n, v, x in made if forms[x] != forms[n]]
    assert missed == [] and len({forms[n] for n in names}) == len(names) and sum(x != n for n, _, x in made) > 60


def test_trie_decides():
    rows = pd.DataFrame([(0, 0, True, "Каталог", 5), (0, 0, True, "Слой", 2), (0, 0, False, "Kaтaлoг", 0), (0, 0, False, "Слои", 0), (1, 0, False, "Каталог", 0)], columns=["shard", "part", "is_entry", "word", "n"])
    got = pd.concat(walk_words(iter([rows[:3], rows[3:]])))
    assert [tuple(r) for r in got.itertuples(index=False)] == [("Kaтaлoг", "Каталог"), ("Слои", None), ("Каталог", None)]


def test_hot_shape_is_split(spark, monkeypatch):
    import lorespark.llm.lookalikes as module

    monkeypatch.setattr(module, "WALKED", 10)
    words = ["Каталог", *("Каталог"[:3] + "\u200b" * i + "Каталог"[3:] for i in range(1, 60)), "Слой"]
    df = spark.createDataFrame([(w, fold(w), "\u200b" not in w, 1) for w in words], "word string, folded string, clean boolean, n long")
    got = {r.word: r.canon for r in module.canonical_words(df).collect()}
    assert len(got) == 61 and {got[w] for w in words[:-1]} == {"Каталог"} and got["Слой"] == "Слой"


def test_names(spark):
    names = [n for g in GROUPS for n in g]
    df = spark.createDataFrame([(n, "clash") for n in [*names, *names[:3], None]], "name string, canon string")
    forms = {r.name: r.canon for r in canonical_names(df).collect()}
    assert forms.keys() == set(names)
    per = [{forms[n] for n in g} for g in GROUPS]
    assert all(len(p) == 1 for p in per) and len(set().union(*per)) == len(GROUPS)
    assert forms[" Дoкyмeнт．Ёлка "] == "Документ.Ёлка"
    rows = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)] + [("0", names[0]), (None, "COM"), ("n", None)], "key string, name string")
    got = {(r.key_a, r.key_b) for r in lookalike_pairs(rows, canonical_names(df), []).collect()}
    at = {n: str(i) for i, n in enumerate(names)}
    assert got == {tuple(sorted((at[a], at[b]))) for g in GROUPS for a in g for b in g if a < b}
    assert canonical_names(df.limit(0)).count() == 0


@data
def test_found_names(spark):
    want = set()
    api = [(str(r.id), r.full_name) for r in spark.read.parquet(f"{SF}/api_objects.parquet").collect() if r.full_name is not None]
    by = {}
    for k, n in api:
        by.setdefault(fold(n), []).append((k, n))
    for g in by.values():
        want |= {("api_objects", "", *sorted((a[0], b[0]))) for a in g for b in g if a[1] < b[1] and a[0] != b[0]}
    by = {}
    for r in spark.read.parquet(f"{SF}/objects.parquet").select("config_name", "object_type", "id", "name").distinct().collect():
        if r.name is not None:
            by.setdefault((r.config_name, r.object_type, fold(r.name)), []).append((r.id, r.name))
    for (c, _, _), g in by.items():
        want |= {("objects", c, *sorted((a[0], b[0]))) for a in g for b in g if a[1] < b[1] and a[0] != b[0]}
    got = [tuple(r[c] for c in ("tab", "scope", "key_a", "key_b")) for r in q.p3_found(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def key_of(path):
    p = unquote(re.sub(r"(?s)#.*$", "", path.strip())).strip()
    p = re.sub(r"[\\/]+", "/", p).lower()
    p = re.sub(r"^(?:[./]+|[0-9]+(?:\.[0-9]+)+/)+", "", p)
    return re.sub(r"\.(html|htm|md)$", "", p)


def test_page_key(spark):
    same = ["a_ru/x/Page One.html", "./8.3.6/a_ru\\x//Page%20One.htm#top ", "/8.3.12.1790/A_RU/X/PAGE ONE.MD", " a_ru/x/page one"]
    rows = [(p,) for p in [*same, "a_ru/x/Page+One.html", "a_ru/x/Page%zzOne.html", None]]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(page_key("p")).collect()]
    assert len(set(got[:4])) == 1 and got[4:] == ["a_ru/x/page+one", "a_ru/x/page%zzone", None]


def vkey(v):
    v = (v or "").strip()
    return tuple(int(x) if x.isdigit() else 0 for x in v.split(".")) if v else ()


def filled(x):
    return bool(x.strip()) if isinstance(x, str) else bool(x)


@data
def test_found_survivors(spark):
    want = set()
    groups = {}
    for r in spark.read.parquet(f"{SF}/api_topics.parquet").collect():
        groups.setdefault(("api_topics", key_of(r.path)), []).append(((vkey(r.version), sum(map(filled, (r.title, r.text, r.entity_type, r.breadcrumb))), r.loaded_at, r.id), r.id))
    for r in spark.read.parquet(f"{SF}/api_members.parquet").collect():
        key = ("api_members", re.sub(r"\s+", "", r.full_name).lower(), r.language)
        groups.setdefault(key, []).append(((max(map(vkey, [*(r.versions or []), r.version])), sum(map(filled, (r.summary, r.description, r.syntax, r.returns))), r.loaded_at, r.id), r.id))
    want = {(k[0], min(i for _, i in g), max(g)[1]) for k, g in groups.items() if len(g) > 1}
    got = [tuple(r) for r in q.p5_found(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert q.p5_topics(spark, SF).count() == len([k for k in groups if k[0] == "api_topics"])


def test_votes(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("g", 3, "1.2", "Old  Title", None, [], t), ("g", 2, "1.10", "new title", " ", ["x"], t), ("g", 5, None, "OLD TITLE", "b", None, t), ("g", 9, "1.10", None, None, ["y", "z"], None),
        ("h", 7, None, None, None, None, None), (None, 8, "9", "x", "x", ["q"], t), ("g", None, "9", "x", "x", ["q"], t),
    ]
    df = spark.createDataFrame(rows, "grp string, id long, version string, f string, body string, tags array<string>, loaded_at timestamp")
    rank = [version_key("version"), filled_count(df, ["f", "body", "tags"])]
    plan = survivors(df, F.col("grp"), "id", rank, [])._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" in plan  # the votes decide, also where only the record is asked for
    got = {r.group_id: r for r in survivors(df, F.col("grp"), "id", rank, ["f", "body", "tags"]).collect()}
    assert got.keys() == {2, 7}
    g = got[2]
    # two votes for the old title, written as the better of its records writes it; an undated record has no vote
    assert (g.best_id, g.n, g.f, g.body, g.tags) == (2, 4, "Old  Title", "b", '["x"]')
    assert (got[7].best_id, got[7].n, got[7].f) == (7, 1, None)
    assert survivors(df.limit(0), F.col("grp"), "id", rank, ["f"]).count() == 0


@data
def test_survivors_have_all_fields(spark):
    for got, name, key, only in ((q.p5_topics(spark, SF), "api_topics", "path", "toc_id"), (q.p5_members(spark, SF), "api_members", "full_name", "owner_name")):
        records = spark.read.parquet(f"{SF}/{name}.parquet")
        assert set(got.columns) == set(records.columns) - {"id"} | {"group_id", "best_id", "n"}
        alone = got.where("n = 1").join(records.select(F.col("id").alias("best_id"), *[F.col(c).cast("string").alias(f"_{c}") for c in (key, only, "language", "loaded_at")]), "best_id").collect()
        assert alone and all(r[c] == r[f"_{c}"] for r in alone for c in (key, only, "language", "loaded_at") if (r[f"_{c}"] or "").strip())
        assert got.where(F.col(key).isNull()).count() == 0


def test_votes_of_fields_for_their_record(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("g", 3, "1.2", "Old  Title", None, [], t), ("g", 2, "1.10", "new title", " ", ["x"], t), ("g", 5, None, "OLD TITLE", "b", None, t), ("g", 9, "1.10", None, None, ["y", "z"], None),
        ("h", 7, None, None, None, None, None), ("i", 4, "1", "a", None, None, t), ("i", 4, "1", "a", None, None, t), ("i", 6, "1", "A", "b", None, None),
    ]
    df = spark.createDataFrame(rows, "grp string, id long, version string, f string, body string, tags array<string>, loaded_at timestamp")
    standing = [version_key("version"), ["f", "body", "tags"]]
    got = {r.group_id: tuple(r)[1:] for r in survivors(df, F.col("grp"), "id", standing, ["f", "body", "tags"], sources=True).collect()}
    # the records that the winners are taken from; a record delivered twice has no more votes than once
    assert got == {2: (2, 4, 3, 5, 2), 7: (7, 1, None, None, None), 4: (6, 3, 6, 6, None)}
    values = {r.group_id: tuple(r)[1:] for r in survivors(df, F.col("grp"), "id", standing, ["f", "body", "tags"]).collect()}
    assert values == {2: (2, 4, "Old  Title", "b", '["x"]'), 7: (7, 1, None, None, None), 4: (6, 3, "A", "b", None)}


@data
def test_found_is_read_off_the_surviving_records(spark, monkeypatch):
    made, save = [], q.Scratch.save
    monkeypatch.setattr(q.Scratch, "save", lambda self, df, *by: made.append(save(self, df, *by)) or made[-1])
    found = {tuple(r) for r in q.p5_found(spark, SF).collect()}
    made = [m for m in made if "best_id" in m.columns]
    assert len(made) == 2
    for winners, full, name in zip(made, (q.p5_topics(spark, SF), q.p5_members(spark, SF)), ("api_topics", "api_members")):
        assert winners.columns == full.columns  # every field was voted for
        records = {r.id: r for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}
        full = {r.group_id: r for r in full.collect()}
        winners = winners.collect()
        assert {(name, r.group_id, r.best_id) for r in winners if r.n > 1} == {r for r in found if r[0] == name}
        for r in winners:
            for c in set(winners[0].asDict()) - {"group_id", "best_id", "n"}:
                value = None if r[c] is None else records[r[c]][c]
                if isinstance(value, (str, type(None))):
                    assert value == full[r.group_id][c]
                else:
                    assert full[r.group_id][c] is not None
