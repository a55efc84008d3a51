"""Parsers, readers and sinks."""

import json
import struct

from pyspark.sql import functions as F

from lorespark.sources import files as S
from lorespark.sources import parsers as P

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>x</style></head><body><h1 class="pagetitle">Запрос (Query)</h1>
<p>Текст&nbsp;и &amp; <a href="../objects/a.html#x">ссылка <b>раз</b></a> <a href="#top">top</a></p><h2>Параметры</h2><ul><li>один</li></ul>
<pre>Если  А Тогда</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"""


def block(payload: bytes, size: int | None = None, following: int = 0x7FFFFFFF) -> bytes:
    return b"\r\n%08x %08x %08x \r\n" % (len(payload), size or len(payload), following) + payload


def container(entries: dict[str, bytes]) -> bytes:
    head = struct.pack("<iiii", -1, 512, 0, 0)
    at = len(head) + 31 + 12 * len(entries)
    listing, body = b"", b""
    for name, data in entries.items():
        n = block(b"\0" * 20 + name.encode("utf-16-le") + b"\0" * 4)
        listing += struct.pack("<iii", at + len(body), at + len(body) + len(n), 0x7FFFFFFF)
        body += n + block(data)
    return head + block(listing) + body


def test_decode_and_repair():
    text = "Привет, мир и все остальные слова"
    assert [P.decode(text.encode(e)) for e in ("utf-8", "cp1251")] == [text] * 2 and P.decode(b"\xef\xbb\xbfx") == "x"
    assert P.decode(b"x" * 11, most=10) == "" and P.decode(None) == ""
    broken = "Это русский текст про отчеты и регистры".encode().decode("cp1251", "ignore")
    assert P.garbled(broken) and not P.garbled(text)
    assert P.repair("Отчет".encode().decode("latin-1")) == "Отчет".encode().decode("latin-1")  # too short to tell
    assert P.repair(None) is None and P.repair(text) == text


def test_container_and_contents():
    got = dict(P.container_entries(container({"PackBlock": b"abc" * 100, "Book": b""})))
    assert got == {"PackBlock": b"abc" * 100, "Book": b""}
    assert list(P.container_entries(b"x")) == []
    toc = '{2,{1,0,1,2,{0,0,{0,0,{"ru","Язык ""А"""},{"en","Lang"}},"a.html"}},{2,1,0,{0,0,{0,0,{"ru","Б"}},""}}}'
    assert P.toc_chunks("﻿" + toc) == [
        {"id": 1, "parent_id": 0, "title_ru": 'Язык "А"', "title_en": "Lang", "html_path": "a.html"},
        {"id": 2, "parent_id": 1, "title_ru": "Б", "title_en": "", "html_path": ""},
    ]
    assert P.toc_chunks("") == [] and P.toc_chunks("{1,{x}}") == []
    assert P.category_names('{8,"field626.html", 9,{3,"b"},"c"}') == ["field626.html", "b", "c"]


def test_html_markdown():
    text, links = P.html_to_markdown(PAGE)
    assert text.startswith("# Запрос (Query)") and "## Параметры" in text and "- один" in text and "```\nЕсли  А Тогда\n```" in text
    assert "| k | v |\n| --- | --- |\n| 1 | 2 |" in text and "[ссылка раз](../objects/a.html#x)" in text
    assert links == [("../objects/a.html#x", "ссылка раз"), ("#top", "top")]
    assert P.resolve_href("x/y/p.html", "../objects/a.html#x") == "x/objects/a.html" and P.resolve_href("p.html", "../../z") is None
    assert P.resolve_href("p.html", "#a") is None and P.resolve_href("p.html", "v8help://x") is None
    s = P.markdown_sections("# T\nintro\n## Синтаксис\nA()\n```\n## Параметры\n```\n## Прочее\nx")
    assert s == {"title": "T", "intro": "intro", "syntax": "A()\n```\n## Параметры\n```"}
    assert P.parameter_lines("**А** (Число) — текст\n- <Б>\nТип: Строка\nпояснение\nпросто") == [
        {"name": "А", "type": "Число", "description": "текст"}, {"name": "<Б>", "type": "Строка", "description": "пояснение"}, {"name": "просто", "type": "", "description": ""},
    ]
    assert P.parameter_lines("<А> (обязательный) Тип: Строка . Имя поля.\n<Б>\n(необязательный) без типа") == [{"name": "<А>", "type": "Строка", "description": "Имя поля."}, {"name": "<Б>", "type": "—", "description": "<Б> (необязательный) без типа"}]


def test_modules_and_forms():
    code = "// x\nПроцедура Один(А)\n  Б = 1;\nКонецПроцедуры\n\nФункция Два()\nКонецФункции\n|КонецФункции"
    assert [(n, i) for n, _, i in P.module_functions(code)] == [("Один", 1), ("Два", 6)]
    form = '<Form xmlns:v8="u"><Attributes><Attribute name="A"><Type><v8:Type>xs:string</v8:Type><v8:Type>xs:decimal</v8:Type></Type></Attribute></Attributes><Commands><Command name="C"><Action>Act</Action><Title><v8:item><v8:content>Заголовок</v8:content></v8:item></Title></Command></Commands></Form>'
    got = P.form_fields(form)
    assert got["attributes"] == [("A", "xs:string", ["xs:string", "xs:decimal"])] and got["commands"] == [("C", "Act", "Заголовок")] and got["error"] is None
    assert P.form_fields("<x")["error"] and P.form_fields('<!DOCTYPE a [<!ENTITY b "c">]><a/>')["error"]


def test_readers(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "8.3.20" / "b").mkdir(parents=True)
    (root / "8.3.20" / "b" / "p.html").write_text(PAGE, encoding="cp1251", errors="xmlcharrefreplace")
    (root / "8.3.20" / "b" / "noext").write_text("<html><h1>N</h1></html>")
    (root / "8.3.20" / "b" / "other").write_text("plain")
    (root / "8.3.20" / "b" / "x.png").write_bytes(b"<html")
    pages = S.page_records(S.read_pages(spark, str(root)))
    got = {r.path: r for r in pages.collect()}
    assert set(got) == {"8.3.20/b/p.html", "8.3.20/b/noext"} and got["8.3.20/b/p.html"].title == "Запрос (Query)"
    assert {(r.href, r.resolved) for r in S.page_link_rows(pages).collect()} == {("../objects/a.html#x", "8.3.20/objects/a.html"), ("#top", None)}
    assert {r.extension: r.n for r in S.counts_by_extension(S.read_files(spark, str(root))).collect()} == {".html": 1, ".png": 1, "": 2}
    (root / "s").mkdir()
    (root / "s" / "m.bsl").write_text("Процедура А()\nКонецПроцедуры\nФункция Б()\nКонецФункции\n")
    (root / "s" / "n.md").write_text("---\ntitle: 'Имя'\ndescription: d\n---\ntext\n```bsl\nX = 1;\n```\n")
    (root / "s" / "README.md").write_text("```bsl\nY\n```")
    (root / "s" / "st.md").write_text("# Стандарт\n\nПервый абзац\nещё.\n\n- список")
    texts = ["# A\n\n- x\n# B\nодин\n два \n\nтри", "", "без заголовка", "| t |\n" + "\n".join(["x" * 90] * 5), "#"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.first_heading(F.col("t")).alias("h"), S.first_paragraph(F.col("t")).alias("p"))
    assert [(r.h, r.p) for r in made.orderBy("i").collect()] == [("A", "один два"), ("", ""), ("", "без заголовка"), ("", " ".join(["x" * 90] * 3)), ("", "")]
    assert S.too_large(S.read_files(spark, str(root)), 5).first().n > 0
    snips = {(r.title, r.source_ref) for r in S.read_snippets(spark, str(root / "s")).collect()}
    assert snips == {("m", "m.bsl"), ("Имя", "n.md")}
    assert {r.title for r in S.read_snippets(spark, str(root / "s"), 3).collect()} == {"m.А", "m.Б", "Имя"}
    assert ("Стандарт", "Первый абзац ещё.") in {(r.title, r.description) for r in S.read_standards(spark, str(root / "s")).collect()}


def test_snapshot_and_sinks(spark, tmp_path):
    d = tmp_path / "snap"
    d.mkdir()
    lines = [json.dumps({"id": 1, "object_name": "A", "versions": ["8.3"]}), "", json.dumps({"id": 2, "summary": "s"})]
    for name in S.SNAPSHOT:
        (d / f"{name}.jsonl").write_text("\n".join(lines) if name == "api_objects" else "")
    tables = S.load_snapshot(spark, str(d))
    rows = {r.id: r for r in tables["api_objects"].collect()}
    assert rows[2].object_name == "" and rows[2].versions == [] and rows[1].versions == ["8.3"]
    m = S.write_snapshot({"api_objects": tables["api_objects"]}, str(tmp_path / "out"), "form_v1")
    assert m["counts"] == {"api_objects": 2} and json.loads(spark.read.text(str(tmp_path / "out/manifest.json")).first()[0]) == m
    path = str(tmp_path / "table")
    for n in (3, 5):
        S.staged_write(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    # a crash before the swap leaves the old table, one in the middle of it ends in the new one
    spark.range(7).write.parquet(path + ".new")
    assert S.recover_staged(spark, path) == "undone" and spark.read.parquet(path).count() == 5
    spark.range(7).write.parquet(path + ".new")
    (tmp_path / "table.swap").touch()
    (tmp_path / "table").rename(tmp_path / "table.old")
    assert S.recover_staged(spark, path) == "finished" and spark.read.parquet(path).count() == 7 and S.recover_staged(spark, path) is None
    (d / "bad.jsonl").write_text('{"id": 1}\n\n{"id": \nx\n')
    assert S.broken_lines(spark, str(d / "bad.jsonl"), "id long").first().n == 2 and S.read_jsonl(spark, str(d / "bad.jsonl"), "id long").count() == 1
    items = spark.createDataFrame([("reference",), ("snippet",), (None,)], "type string")
    assert [x.count() for x in S.split_by_type(items)] == [1, 2]
    hbk = spark.createDataFrame([("8.3.20/a_ru.hbk",), ("8.3.20/b_en.hbk",), ("8.3.20/c.txt",)], "path string")
    assert [tuple(r) for r in S.discover(hbk, ["ru"]).collect()] == [("8.3.20/a_ru.hbk", "8.3.20", "ru")]
    files = spark.createDataFrame([("f", bytearray(container({"X": b"1"})))], "path string, content binary")
    assert [(r.name, bytes(r.body)) for r in S.container_rows(files).collect()] == [("X", b"1")]


def test_export_xml(spark, tmp_path):
    rec = lambda kind, **f: f"<CatalogObject.{kind}>" + "".join(f"<{k}>{v}</{k}>" for k, v in f.items()) + f"</CatalogObject.{kind}>"
    xml = "<Data>" + rec("Объекты", Ref="o1", Имя="Заказ", Тип="Документ") + rec("Свойства", Ref="s1", Owner="o1", Parent="0", Имя="Товары", Вид="ТабличнаяЧасть")
    xml += rec("Свойства", Ref="f1", Owner="o1", Parent="s1", Имя="Цена", Вид="Реквизит") + rec("Свойства", Ref="f2", Owner="zz", Parent="0", Имя="Лишнее", Вид="Реквизит")
    xml += rec("Свойства", Ref="f3", Owner="o1", Parent="0", Description="Дата", Вид="Реквизит") + "</Data>"
    (tmp_path / "e.xml").write_text(xml)
    read = lambda k: S.read_export(spark, str(tmp_path / "e.xml"), k)
    got = S.export_objects(read("Объекты"), read("Свойства")).collect()
    assert len(got) == 1 and got[0].name == "Заказ" and {(f.section, f.field) for f in got[0].fields} == {("Товары", "Цена"), (None, "Дата")}
    both = S.union_configs([read("Объекты").select("Ref"), read("Свойства").select("Ref", "Owner")])
    assert both.columns == ["Ref", "Owner"] and both.count() == 5


def test_udfs(spark):
    df = spark.createDataFrame([("## Параметры\n**А** (Число)", "Процедура А()\nКонецПроцедуры"), (None, None)], "t string, c string")
    a, b = df.select(S.sections_of("t").alias("s"), S.functions_of("c").alias("f"), S.toc_of("t").alias("toc"), S.categories_of("t").alias("cat"), S.form_of("t").alias("form")).collect()
    assert a.s == {"params": "**А** (Число)"} and a.f[0].name == "А" and b.s == {} and b.f == [] and b.form.error
    assert df.select(S.parameters_of(F.lit("**А** (Число)")).alias("p")).first().p[0].type == "Число"
