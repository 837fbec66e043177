"""What keeps a bundle in order: repair of front matter and derived files to a fixed point, sealing of summaries, manifests of raw files, dumps, findings
as JSON, a new bundle's folders, and a check of what a session can do."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import saved
from ..sources import markdown
from ..sources.bundle import Bundle
from . import derived
from .contract import Contract

# ------------------------------------------------ texts and files

def write_if_changed(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a text in UTF-8 with line feeds alone, unless the file holds those bytes; tells whether it wrote."""
    hadoop, data = spark._jvm.org.apache.hadoop.fs, text.replace("\r\n", "\n").replace("\r", "\n").encode()
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        stream = fs.open(at)
        try:
            if bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) == data:
                return False
        finally:
            stream.close()
    out = fs.create(at, True)
    out.write(bytearray(data))
    out.close()
    return True


def sealed(text: str) -> str:
    """A document with resumen_hash set to the hash of its body; unchanged where it has no front matter that can be read, or has that hash."""
    doc = markdown.parsed(text)
    own = markdown.body_hash(text)
    if not doc.has_front or doc.error or doc.meta.get("resumen_hash") == own:
        return text
    parts = text.splitlines(keepends=True)
    end = next((c for c in ("\r\n", "\n", "\r") if parts[0].endswith(c)), "\n")
    at = next((i for i, line in enumerate(parts[1 : doc.body_start - 1], 1) if re.match(r"resumen_hash\s*:", line)), None)
    line = f"resumen_hash: {own}{end}"
    return "".join([*parts[:at], line, *parts[at + 1 :]] if at is not None else [*parts[: doc.body_start - 1], line, *parts[doc.body_start - 1 :]])


def quoted_where_needed(text: str, contract: Contract) -> str:
    """A document with the plain values in quotes that YAML readers would take otherwise; what stands after them as a comment stays."""
    doc = markdown.parsed(text)
    if not doc.has_front:
        return text
    kind = doc.meta.get("type")
    kinds = {n: f.kind for n, f in contract.fields(kind if isinstance(kind, str) else "").items()}
    parts = text.splitlines(keepends=True)
    for number, _, why, breaks in markdown.hazards([x.rstrip("\r\n") for x in parts[1 : doc.body_start - 1]], kinds):
        if not breaks:
            continue
        line = parts[number]
        body = line.rstrip("\r\n")
        head = markdown.KEY.match(body)
        value = body[head.end() :]
        plain = markdown.uncommented(value).strip()
        if plain:
            parts[number] = f"{head[0]} {markdown.in_quotes(plain)}" + value.rstrip()[len(markdown.uncommented(value)) :] + line[len(body) :]
    return "".join(parts)


def _each(contract: Contract, change):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            new = []
            for content in frame["content"]:
                try:
                    new.append(change(bytes(content).decode("utf-8"), contract).encode())
                except UnicodeDecodeError:  # not for us to write anew
                    new.append(bytes(content))
            yield frame.assign(content=new)

    return run


def fixed(content: DataFrame, contract: Contract, today: str, specs=derived.SPECS, passes: int = 3) -> DataFrame:
    """The files (path, content) of a bundle repaired: values quoted where they need it, indexes and derived files made anew, until a pass
    changes nothing, three times at most. Front matter of derived files stays; files that are not derived keep their bytes but for quotes."""
    now = saved(content.select("path", "content").mapInPandas(_each(contract, quoted_where_needed), "path string, content binary"), "fixed")
    for _ in range(passes):
        bundle = Bundle(now, contract)
        want = saved(derived.expected(bundle, contract, today, specs), "derived")
        off = derived.stale(want, derived.body_lines(bundle.parsed), bundle.parsed.select("path")).select("path")
        off = saved(off, "stale")
        if off.isEmpty():
            break
        # a derived file is written as one text, so its lines are gathered
        made = want.join(off, "path", "left_semi").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
        front = bundle.parsed.filter("has_front").select("path", F.regexp_extract("text", r"(?s)\A(---\r?\n.*?\r?\n---\r?\n)", 1).alias("front"))
        made = made.join(front, "path", "left").select("path", F.concat(F.coalesce("front", F.lit("")), F.when(F.coalesce("front", F.lit("")) != "", F.lit("\n")).otherwise(F.lit("")), F.rtrim("body"), F.lit("\n")).cast("binary").alias("content"))
        now = saved(now.join(off, "path", "left_anti").unionByName(made), "fixed")
    return now


# ------------------------------------------------ manifests of raw files

#: A line of a manifest: path, SHA-256, bytes, day, origin. The shape is this library's choice.
MANIFEST = r"^\|\s*`?([^|`]+?)`?\s*\|\s*([0-9a-f]{64}|-?)\s*\|\s*(\d*)\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|\s*$"


def manifest(lines: DataFrame) -> DataFrame:
    """file, sha256 (null where there is none), bytes, day and origin from rows (line) of a manifest; its head and other lines are passed over."""
    part = lambda i: F.regexp_extract("line", MANIFEST, i)
    rows = lines.filter(F.col("line").rlike(MANIFEST) & ~part(1).rlike(r"^:?-+:?$"))
    return rows.select(part(1).alias("file"), F.when(part(2).rlike("^[0-9a-f]{64}$"), part(2)).alias("sha256"), part(3).try_cast("long").alias("bytes"), part(4).alias("day"), part(5).alias("origin"))


def integrity(stated: DataFrame, files: DataFrame) -> DataFrame:
    """file and state (ok, changed, no hash, missing, orphan) of what a manifest says against the files (path, content) there are. Of a file named twice
    the last statement by day counts."""
    last = stated.groupBy("file").agg(F.max_by(F.struct("sha256"), F.struct("day", "sha256")).alias("x")).select("file", F.col("x.sha256").alias("stated"), F.lit(True).alias("named"))
    real = files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("real"))
    state = F.when(F.col("named").isNull(), "orphan").when(F.col("real").isNull(), "missing").when(F.col("stated").isNull(), "no hash").when(F.col("stated") == F.col("real"), "ok").otherwise("changed")
    return last.join(real, "file", "full_outer").select("file", state.alias("state"))


# ------------------------------------------------ dumps and reports

def dump(df: DataFrame) -> DataFrame:
    """Rows as JSON text in the order of all columns: equal tables give equal dumps."""
    return df.orderBy(*(F.col(c).asc_nulls_first() for c in df.columns)).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def as_json(findings: DataFrame) -> DataFrame:
    """Findings as one JSON object a row, in their order."""
    return findings.select(F.to_json(F.struct("rule", "severity", "path", "line", "message"), {"ignoreNullFields": "false"}).alias("finding"))


def by_severity(findings: DataFrame) -> DataFrame:
    """How many findings each rule has of each severity, and in all."""
    return findings.groupBy("rule").pivot("severity", ["error", "warning", "info"]).count().na.fill(0).withColumn("total", F.col("error") + F.col("warning") + F.col("info"))


# ------------------------------------------------ roles

def profiles(base: DataFrame, own: DataFrame) -> DataFrame:
    """slug and content of role profiles from two tables of files (path, content): a file's name is its slug, and one of the bundle's own takes the place of a
    base one."""
    slug = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    both = base.select(slug.alias("slug"), F.lit(0).alias("rank"), "content").unionByName(own.select(slug.alias("slug"), F.lit(1).alias("rank"), "content")).filter("slug <> ''")
    first = Window.partitionBy("slug").orderBy(F.desc("rank"), F.sha2("content", 256))
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").select("slug", "content", F.when(F.col("rank") == 1, "own").otherwise("base").alias("origin"))


def archive_periods(paths: DataFrame) -> DataFrame:
    """Periods of archived folders, each once, with how many documents they hold."""
    period = F.array_distinct(F.regexp_extract_all("path", F.lit(r"(?:^|/)04-archivo/([^/]+)/"), F.lit(1)))
    return paths.select(F.explode(period).alias("periodo")).groupBy("periodo").agg(F.count("*").alias("n"))


# ------------------------------------------------ a new bundle, and what a session can do

def begin(spark: SparkSession, root: str, contract: Contract | None = None) -> list[str]:
    """The folders' indexes, the log, the query log and the generated artifacts of a new bundle; what is there stays as it is. Gives the paths written."""
    contract = contract or Contract()
    top = sorted({p.split("/")[0] for places in contract.places.values() for p in places})
    wanted = {"index.md": "# Índice\n", "log.md": "# Registro\n", "log-consultas.md": "# Consultas\n"} | {f"{t}/index.md": f"# {t}\n" for t in top} | contract.artifacts()
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for name, text in wanted.items():
        at = hadoop.Path(f"{root.rstrip('/')}/{name}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            write_if_changed(spark, at.toString(), text)
            out.append(name)
    return out


def stale_artifacts(content: DataFrame, contract: Contract) -> DataFrame:
    """path and state (absent or stale) of the generated schema files among files (path, content); as many as there are types."""
    want = content.sparkSession.createDataFrame(list(contract.artifacts().items()), "path string, want string")
    have = content.select("path", F.decode("content", "UTF-8").alias("have"))
    state = F.when(F.col("have").isNull(), "absent").when(F.col("have") != F.col("want"), "stale")
    return want.join(have, "path", "left").select("path", state.alias("state")).filter("state is not null")


def capabilities(spark: SparkSession) -> DataFrame:
    """name and ok: what the queries need of a session, tried on rows of its own."""
    one = spark.createDataFrame([("Árbol", "2026-01-01", [1, 2], '{"k": 1}')], "t string, d string, a array<int>, j string")
    tests = {
        "window": lambda: one.select(F.row_number().over(Window.orderBy("t"))).first()[0] == 1,
        "recursion": lambda: spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT max(n) FROM r").first()[0] == 3,
        "json": lambda: one.select(F.get_json_object("j", "$.k")).first()[0] == "1",
        "digest": lambda: one.select(F.sha2("t", 256)).first()[0] == hashlib.sha256("Árbol".encode()).hexdigest(),
        "dates": lambda: one.select(F.datediff(F.lit("2026-01-31").try_cast("date"), F.col("d").try_cast("date"))).first()[0] == 30,
        "lists": lambda: one.select(F.posexplode("a")).count() == 2,
        "python": lambda: one.select("t").mapInPandas(lambda fs: (f for f in fs), "t string").count() == 1,
        "adaptive": lambda: spark.conf.get("spark.sql.adaptive.enabled", "true") == "true",
        "utc": lambda: spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z"),
        "shared folder": lambda: saved(one, "probe").count() == 1,
    }
    out = []
    for name, test in tests.items():
        try:
            ok, why = bool(test()), None
        except Exception as e:  # what is missing is the answer
            ok, why = False, f"{type(e).__name__}: {e}".split("\n")[0][:200]
        out.append((name, ok, why))
    return spark.createDataFrame(out, "name string, ok boolean, why string")
