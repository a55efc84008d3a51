"""Readers of file trees and snapshots, and the sinks that belong to them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.text import let, text_or_empty
from lorespark.sources import parsers as P

# The five tables of a snapshot: one typed schema each.
SNAPSHOT = {
    "api_objects": "id long, object_name string, full_name string, kind string, title string, summary string, description string, version string, versions array<string>, language string, topic_path string, breadcrumb array<string>, aliases array<string>, availability string",
    "api_members": "id long, owner_name string, member_name string, full_name string, kind string, summary string, description string, syntax string, version string, versions array<string>, returns string, language string, topic_path string, params array<struct<name: string, type: string, description: string>>",
    "api_examples": "id long, owner_name string, member_name string, full_name string, kind string, title string, description string, code string, topic_path string, version string, language string",
    "api_links": "id long, source_full_name string, target_name string, target_lookup string, link_kind string, topic_path string, resolved_target_topic_path string, href string, version string, language string",
    "api_topics": "id long, path string, title string, text string, version string, language string, entity_type string, breadcrumb array<string>",
}


def never_null(df: DataFrame) -> DataFrame:
    """Missing texts become '' and missing lists [], as the index layer keeps them."""
    cells = []
    for f in df.schema:
        empty = F.lit("") if isinstance(f.dataType, T.StringType) else F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else None
        cells.append(F.coalesce(F.col(f.name), empty).alias(f.name) if empty is not None else F.col(f.name))
    return df.select(*cells)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are skipped, broken ones are left out (broken_lines() counts them)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(n, first_line) of the lines that are neither blank nor JSON of this schema."""
    row = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    lines = spark.read.text(path).where(F.trim("value") != "").select(row["_broken"].alias("_broken"))
    return lines.agg(F.count("_broken").alias("n"), F.min("_broken").alias("first_line"))


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: never_null(read_jsonl(spark, f"{path}/{name}.jsonl", schema)) for name, schema in SNAPSHOT.items()}


def write_snapshot(tables: dict[str, DataFrame], path: str, form: str) -> dict:
    """Write each table as lines of JSON, counted on the way, and a manifest with the counts that marks the end."""
    counts = {}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/{name}.jsonl")
        counts[name] = int(seen.get["n"])
    manifest = {"format": form, "counts": counts}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
    return manifest


def union_configs(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path below the root, length, modified, content) of all files of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    below = F.substring_index(F.col("path"), path.rstrip("/").split("/")[-1] + "/", -1)
    return files.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def arrow_udf(kind: str) -> Callable:
    """A pandas UDF that is made when it is first used, since the type is parsed by the session."""

    def wrap(f: Callable) -> Callable:
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return wrap


@arrow_udf("string")
def decode_bytes(content: pd.Series) -> pd.Series:
    return content.map(P.decode)


@arrow_udf("string")
def repair_text(text: pd.Series) -> pd.Series:
    return text.map(P.repair)


@arrow_udf("struct<markdown string, links array<struct<href string, text string>>>")
def page_to_markdown(page: pd.Series) -> pd.DataFrame:
    made = [P.html_to_markdown(x) for x in page]
    return pd.DataFrame({"markdown": [m for m, _ in made], "links": [[{"href": h, "text": t} for h, t in links] for _, links in made]})


@arrow_udf("map<string,string>")
def sections_of(text: pd.Series) -> pd.Series:
    return text.map(P.markdown_sections)


@arrow_udf("array<struct<name string, type string, description string>>")
def parameters_of(text: pd.Series) -> pd.Series:
    return text.map(P.parameter_lines)


@arrow_udf("array<struct<name string, code string, line_start int>>")
def functions_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [{"name": n, "code": c, "line_start": i} for n, c, i in P.module_functions(x)])


@arrow_udf("array<struct<id long, parent_id long, title_ru string, title_en string, html_path string>>")
def toc_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: P.toc_chunks(x or ""))


@arrow_udf("array<string>")
def categories_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: P.category_names(x or ""))


@arrow_udf("struct<attributes array<struct<name string, type string, types array<string>>>, commands array<struct<name string, action string, title string>>, error string>")
def form_of(text: pd.Series) -> pd.DataFrame:
    made = [P.form_fields(x) for x in text]
    return pd.DataFrame(
        {
            "attributes": [[{"name": n, "type": t, "types": ts} for n, t, ts in m["attributes"]] for m in made],
            "commands": [[{"name": n, "action": a, "title": t} for n, a, t in m["commands"]] for m in made],
            "error": [m["error"] for m in made],
        }
    )


def container_rows(files: DataFrame) -> DataFrame:
    """(path, name, body) of the entries of containers (path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, body) for p, c in zip(b["path"], b["content"]) for n, body in P.container_entries(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "name", "body"])

    return files.select("path", "content").mapInPandas(read, "path string, name string, body binary")


BINARY = r"(?i)\.(png|gif|jpe?g|ico|bmp|css|js|zip|exe|dll|st|bin)$"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of HTML files; files without an extension count if they begin like HTML, known binary ones never."""
    files = read_files(spark, path).where(~F.col("path").rlike(BINARY))
    head = F.lower(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"))
    sniffed = F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype"))
    name = F.substring_index("path", "/", -1)
    kept = files.where(name.rlike(r"(?i)\.html?$") | (~F.contains(name, F.lit(".")) & sniffed))
    return kept.select("path", decode_bytes("content").alias("html"))


def page_records(pages: DataFrame) -> DataFrame:
    """(path, title, text, links, sections) of pages (path, html)."""
    made = pages.select("path", page_to_markdown("html").alias("m"))
    out = made.select("path", F.col("m.markdown").alias("text"), F.col("m.links").alias("links")).withColumn("sections", sections_of("text"))
    return out.select("path", F.coalesce(F.col("sections")["title"], F.lit("Untitled")).alias("title"), "text", "links", "sections")


def read_snippets(spark: SparkSession, path: str, per_function_min_lines: int | None = None) -> DataFrame:
    """(title, description, code_snippet, source_ref) of script modules and of Markdown files with a code block.

    Modules of at least so many lines are cut into their functions if per_function_min_lines is given.
    """
    files = read_files(spark, path)
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    modules = files.where(name.rlike(r"(?i)\.(bsl|1c)$")).select("path", stem.alias("stem"), decode_bytes("content").alias("text")).where("trim(text) <> ''")
    whole = modules.select(F.col("stem").alias("title"), F.lit("").alias("description"), F.trim("text").alias("code_snippet"), F.col("path").alias("source_ref"))
    if per_function_min_lines is not None:
        lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
        long = modules.where(lines >= per_function_min_lines).select("path", "stem", F.explode(functions_of("text")).alias("f"))
        whole = modules.where(lines < per_function_min_lines).select(F.col("stem").alias("title"), F.lit("").alias("description"), F.trim("text").alias("code_snippet"), F.col("path").alias("source_ref"))
        whole = whole.unionByName(long.select(F.concat_ws(".", "stem", "f.name").alias("title"), F.lit("").alias("description"), F.col("f.code").alias("code_snippet"), F.concat_ws("#", "path", "f.name").alias("source_ref")))
    notes = files.where(name.rlike(r"(?i)\.md$") & (F.lower(name) != "readme.md")).select("path", stem.alias("stem"), decode_bytes("content").alias("text"))
    head = F.regexp_extract("text", r"(?s)^---\s*\n(.*?)\n---", 1)
    value = lambda k: F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?im)^{k}\s*:\s*(.*)$", 1)), "^['\"]|['\"]$", "")
    code = F.trim(F.regexp_extract("text", r"(?s)```(?:bsl|1c)?\s*\n(.*?)```", 1))
    named = notes.select(F.coalesce(F.nullif(value("title"), F.lit("")), "stem").alias("title"), value("description").alias("description"), code.alias("code_snippet"), F.col("path").alias("source_ref"))
    return whole.unionByName(named.where("code_snippet <> ''"))


def first_heading(text: Column) -> Column:
    """The first heading of the first level; '' if there is none."""
    return F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))


def first_paragraph(text: Column, enough: int = 200, most: int = 300) -> Column:
    """The first run of lines that are neither blank nor headings, lists or tables, up to the line that makes `enough` characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    ends = lambda x: (x == "") | F.substring(x, 1, 1).isin("#", "|", "-")
    run = lambda x: F.slice(x, 1, F.coalesce(F.nullif(F.array_position(F.transform(x, ends), True), F.lit(0)).cast("int") - 1, F.size(x)))
    start = lambda x: F.slice(x, F.greatest(F.array_position(F.transform(x, ends), False).cast("int"), F.lit(1)), F.size(x))
    words = let(let(lines, start), run)
    kept = let(words, lambda w: F.filter(w, lambda x, i: (i == 0) | (F.length(F.array_join(F.slice(w, 1, i), " ")) < enough)))
    return F.trim(F.substring(F.array_join(kept, " "), 1, most))


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    """(title, description, instruction, source_ref) of Markdown files: first heading (or file name), first paragraph."""
    files = read_files(spark, path, "*.md").select("path", decode_bytes("content").alias("text")).where("trim(text) <> '' and not lower(path) like '%readme.md'")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.select(F.coalesce(F.nullif(first_heading(F.col("text")), F.lit("")), stem).alias("title"), first_paragraph(F.col("text")).alias("description"), F.col("text").alias("instruction"), F.col("path").alias("source_ref"))


def too_large(files: DataFrame, most: int = P.MAX_FILE) -> DataFrame:
    """(n, bytes) of the files that decode_bytes() leaves out for their size; files has the column length."""
    return files.where(F.col("length") > most).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def split_by_type(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reference items, snippets)."""
    ref = F.coalesce(F.col("type") == "reference", F.lit(False))
    return items.where(ref), items.where(~ref)


def discover(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(path, version, language) of archives `version/stem_xx.hbk`; other files are left out."""
    found = files.where(F.lower("path").endswith(".hbk")).select("path", F.regexp_extract("path", r"([0-9]+(?:\.[0-9]+)+)/", 1).alias("version"), F.regexp_extract(F.lower("path"), r"_([a-z]{2})\.hbk$", 1).alias("language"))
    return found.where(F.col("language").isin(languages)) if languages else found


_ELEMENT = "Ref string, Owner string, Parent string, IsFolder string, Description string, `Имя` string, `Синоним` string, `Комментарий` string, `Тип` string, `Вид` string, `Версия` string, `Использование` string, `Индексирование` string"


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind (`Объекты`, `Свойства`, `Значения`, `Конфигурации`) of a metadata export in XML."""
    return spark.read.format("xml").option("rowTag", f"CatalogObject.{kind}").schema(_ELEMENT).load(path)


def export_objects(objects: DataFrame, properties: DataFrame) -> DataFrame:
    """Objects with their fields and tabular sections: properties joined to owners, fields to sections by parent.

    Properties of unknown owners are dropped. Fields are gathered per object; an object's fields are bounded by its
    definition.
    """
    name = F.coalesce(F.nullif(F.trim("`Имя`"), F.lit("")), F.trim("Description"), F.lit(""))
    o = objects.where(F.coalesce(F.trim("Ref"), F.lit("")) != "").select(F.trim("Ref").alias("ref"), name.alias("name"), text_or_empty("`Тип`").alias("type"))
    p = properties.select(F.trim("Ref").alias("pref"), F.trim("Owner").alias("ref"), F.trim("Parent").alias("parent"), name.alias("field"), text_or_empty("`Вид`").alias("kind"))
    sections = p.where("kind = 'ТабличнаяЧасть'").select(F.col("pref").alias("parent"), F.col("field").alias("section"))
    fields = p.where("kind <> 'ТабличнаяЧасть'").join(sections, "parent", "left")
    per = fields.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("section", "field", "kind"))).alias("fields"))
    return o.join(per, "ref", "left").select("ref", "name", "type", F.coalesce("fields", F.array().cast(per.schema["fields"].dataType)).alias("fields"))


def counts_by_extension(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract(F.substring_index("path", "/", -1), r"(\.[^.]*)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def recover_staged(spark: SparkSession, path: str) -> str | None:
    """Finish or undo a staged_write() that was interrupted: `finished`, `undone` or None if there was nothing to do.

    A new table counts as whole if its marker says so; then it takes the place of the old one. Otherwise what is left of
    it is removed and the old table stays, or comes back if it had been put aside.
    """
    jvm = spark._jvm
    where = lambda s: jvm.org.apache.hadoop.fs.Path(s)
    fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old, marker = where(f"{path}.new"), where(f"{path}.old"), where(f"{path}.swap")
    done = None
    if fs.exists(marker) and fs.exists(new):
        if fs.exists(where(path)):
            fs.delete(old, True)
            fs.rename(where(path), old)
        fs.rename(new, where(path))
        done = "finished"
    elif fs.exists(new) or fs.exists(old):
        if fs.exists(old) and not fs.exists(where(path)):
            fs.rename(old, where(path))
        done = None if fs.exists(marker) else "undone"
    fs.delete(new, True)
    fs.delete(old, True)
    fs.delete(marker, True)
    return done


def staged_write(df: DataFrame, path: str) -> None:
    """Write beside the target, set a marker, then swap by two renames.

    Between the renames no table is at `path`; a reader that meets this, or the next writer after a crash, calls
    recover_staged(), which ends in the new table if it was whole and in the old one if not.
    """
    spark = df.sparkSession
    recover_staged(spark, path)
    df.write.parquet(f"{path}.new")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.swap")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True).close()
    recover_staged(spark, path)


def page_link_rows(records: DataFrame, known: Column | None = None) -> DataFrame:
    """(path, href, text, resolved) of the links of page_records(); resolved is null for anchors and outside links."""

    @F.pandas_udf("string")
    def resolve(page: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([P.resolve_href(p, h) for p, h in zip(page, href)], dtype=object)

    flat = records.select("path", F.explode("links").alias("l"))
    return flat.select("path", F.col("l.href").alias("href"), F.col("l.text").alias("text"), resolve("path", F.col("l.href")).alias("resolved"))


def read_items_json(spark: SparkSession, path: str) -> DataFrame:
    """Snippets of JSON arrays (title, description, code_snippet, type, source_ref), source_ref by default `file#i`."""
    schema = "title string, description string, code_snippet string, instruction string, detail_url string, type string, source_ref string"
    texts = spark.read.option("wholetext", True).text(path).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "value")
    rows = texts.select("file", F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")).alias("i", "x"))
    return rows.select("x.*", "file", "i").withColumn("source_ref", F.coalesce("source_ref", F.concat_ws("#", "file", F.col("i").cast("string")))).drop("file", "i")


def zip_rows(files: DataFrame) -> DataFrame:
    """(path, name, body) of the entries of zip archives (path, content); other files give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                        rows += [(p, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "name", "body"])

    return files.select("path", "content").mapInPandas(read, "path string, name string, body binary")


def find_exports(files: DataFrame) -> DataFrame:
    """(path, length) of metadata exports: XML files that name catalogue objects in their first 4,096 bytes, largest first."""
    head = F.decode(F.substring("content", 1, 4096), "UTF-8")
    found = files.where(F.lower("path").endswith(".xml") & head.rlike("CatalogObject[.]|<Конфигурация"))
    return found.select("path", "length").orderBy(F.desc("length"), "path")


def config_label(configs: DataFrame, name: str = "config_name", version: str = "config_version") -> DataFrame:
    """(label, version) of several configurations: the first three names and "…", the version or "multiple"."""
    names, versions = configs.select(name).distinct(), configs.select(version).distinct()
    first = names.orderBy(name).limit(4).agg(F.array_sort(F.collect_list(name)).alias("n"))
    label = F.when(F.size("n") > 3, F.concat(F.array_join(F.slice("n", 1, 3), ", "), F.lit(", …"))).otherwise(F.array_join("n", ", "))
    one = versions.agg(F.when(F.count("*") == 1, F.max(version)).otherwise("multiple")).scalar()
    return first.select(label.alias("label"), one.alias("version"))


def resolve_types(fields: DataFrame, key: str, types: str, refs: DataFrame) -> DataFrame:
    """(key, types) with the references of an array of types replaced by names of refs (ref, name), raw where unknown.

    Types repeat a lot, so they meet the names once each; a field's types are put back in their order, each once.
    """
    flat = fields.select(key, F.posexplode(types).alias("at", "t")).where("trim(t) <> ''")
    named = flat.select("t").distinct().join(refs.select(F.col("ref").alias("t"), F.col("name").alias("_name")), "t", "left")
    met = flat.join(named, "t").select(key, "at", F.coalesce(F.nullif("_name", F.lit("")), "t").alias("t"))
    per = met.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"])).alias("types"))
    return fields.select(key).join(per, key, "left").select(key, F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def index_rows(pages: DataFrame, version: str, language: str) -> DataFrame:
    """Pages as rows of the index: id, text cut to 50,000 characters, keywords, kind, links; blank pages are left out."""
    from lorespark.functions.text import entity_type, keywords, point_id

    rec = page_records(pages).where("trim(text) <> ''")
    none = F.array().cast("array<string>")
    return rec.select(
        point_id(F.lit(version), F.lit(language), F.col("path")).alias("id"), "path", "title", F.substring("text", 1, 50_000).alias("text"), F.lit(version).alias("version"), F.lit(language).alias("language"), "links", keywords("text").alias("keywords"), entity_type("path", none).alias("entity_type")
    )


@arrow_udf("array<struct<title string, code string, description string>>")
def listing_of(page: pd.Series) -> pd.Series:
    """Items of a fetched listing page: a heading, the text up to its code block and the code; the first of a title counts."""

    def items(text: str | None) -> list[dict]:
        out: dict[str, dict] = {}
        whole = "\n" + P.html_to_markdown(text)[0]
        for part in whole.split("\n## ")[1:] or whole.split("\n### ")[1:]:
            title, _, rest = part.partition("\n")
            before, _, code = rest.partition("```\n")
            title = title.strip("# ").strip()
            if title and title not in out:
                out[title] = {"title": title, "code": code.split("\n```")[0].strip(), "description": " ".join(before.split())}
        return list(out.values())

    return page.map(items)
