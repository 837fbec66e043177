"""The 22 tables of the corpus model, mapped from the star-schema tables by arithmetic on keys.

Every row of a source table gives a row of the model; some key remainders carry the defects that the checks and constraints look for: two
initiatives of one project, a period, a category and a log count that can't be, keys that repeat or lead nowhere, values that are missing. All are lazy
DataFrames: what a query does not use, Catalyst leaves out.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir, stamp

#: Fixed values of the model: the tables in order, and the types with the code that their common fields are derived with.
TABLES = "documentos documentos_tags documentos_verified documentos_sources analisis decision decision_decisores diagrama glosario iniciativa iniciativa_sistemas iniciativa_personas insumo lineamiento persona plan playbook pregunta reunion reunion_asistentes sistema consultas".split()
TYPES = {"Persona": 0, "Sistema": 1, "Iniciativa": 2, "Decision": 3, "Pregunta": 4, "Lineamiento": 5, "Reunion": 6, "Plan": 7, "Diagrama": 8, "Playbook": 9, "Glosario": 10, "Analisis": 11, "Insumo": 12}
COLUMNS = {
    "analisis": "doc proyecto fecha", "decision": "doc proyecto estado fecha valido_desde valido_hasta reemplazada_por", "diagrama": "doc proyecto clase version", "glosario": "doc", "iniciativa": "doc proyecto origen periodo estado",
    "insumo": "doc proyecto formato original", "lineamiento": "doc area fuente estado fecha valido_desde valido_hasta reemplazada_por", "persona": "doc rol equipo reports_to", "plan": "doc proyecto source_of_truth external_tracker last_review",
    "playbook": "doc proyecto", "pregunta": "doc proyecto estado responsable bloqueante created respondida_por", "reunion": "doc proyecto fecha", "sistema": "doc owner categoria estado",
}

#: Types with titles that are their name and their number.
NUMBERED = ("Decision", "Pregunta", "Lineamiento", "Reunion", "Plan", "Diagrama", "Playbook", "Analisis", "Insumo")

_PERSON = "concat('/02-areas/personas/c', {}, '.md')"
_DAY = "concat('2026-', lpad(cast(1 + {0} % 12 as string), 2, '0'), '-', lpad(cast(1 + {0} % 28 as string), 2, '0'))"


def _pick(key: str, *values: str | None) -> str:
    """The value at key modulo their number."""
    return f"element_at(array({', '.join('null' if v is None else repr(v) for v in values)}), cast({key} % {len(values)} as int) + 1)"


class Star:
    """The model over one directory of the star tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:  # the schema is read from the files once
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # ------------------------------------------------ a source for each type: doc, num, title, cuerpo and own fields

    @cached_property
    def _nation(self) -> DataFrame:
        return F.broadcast(self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.lower("r_name").alias("area")))  # 25 rows at any size

    def _src_persona(self) -> DataFrame:
        rows = self.raw("customer").join(self._nation, F.col("c_nationkey") == F.col("n_nationkey"))
        boss = "case when c_custkey % 150 = 7 then -1 when c_custkey % 200 = 0 then c_custkey + 10 when c_custkey % 200 = 10 then c_custkey - 10 when c_custkey % 10 <> 0 then c_custkey - c_custkey % 10 end"
        return rows.selectExpr("concat('02-areas/personas/c', c_custkey, '.md') doc", "c_custkey num", "c_name title", "c_name cuerpo", "c_mktsegment rol", "n_name equipo", f"{_PERSON.format(boss)} reports_to")

    def _src_sistema(self) -> DataFrame:
        rows = self.raw("supplier").join(self._nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.selectExpr("concat('03-recursos/sistemas/s', s_suppkey, '.md') doc", "s_suppkey num", "s_name title", "s_name cuerpo", f"if(s_suppkey % 2 = 0, {_PERSON.format('1 + s_suppkey % 100')}, n_name) owner", f"if(s_suppkey % 10 = 3, 'otra', {_pick('s_suppkey', 'sistema', 'herramienta', 'producto', 'proceso')}) categoria", f"{_pick('s_suppkey', 'activo', 'en-cambio', 'deprecado')} estado")

    def _src_iniciativa(self) -> DataFrame:
        return self.raw("part").selectExpr("concat('01-proyectos/p', p_partkey, '/CONTEXT.md') doc", "p_partkey num", "p_name title", "p_type cuerpo", "concat('p', if(p_partkey % 500 = 3, p_partkey - 1, p_partkey)) proyecto", f"{_pick('p_partkey', 'proyecto-asignado', 'objetivo-personal', 'objetivo-equipo')} origen", "if(p_partkey % 180 = 9, concat('Q', 1 + p_size % 4, '-2026'), concat('2026-Q', 1 + p_size % 4)) periodo", f"{_pick('p_partkey', 'iniciando', 'en-progreso', 'bloqueada', 'entregada')} estado")

    def _src_decision(self) -> DataFrame:
        rows = self.raw("orders").withColumn("day", F.to_date("o_orderdate"))
        return rows.selectExpr(
            "concat('01-proyectos/p', 1 + o_orderkey % 200, '/02-decisiones/dec-', o_orderkey, '.md') doc", "o_orderkey num", "concat('Decision ', o_orderkey) title", "o_orderpriority cuerpo", "concat('p', 1 + o_orderkey % 200) proyecto",
            "if(o_orderstatus = 'P', 'propuesta', 'aceptada') estado", "date_format(day, 'yyyy-MM-dd') fecha", "date_format(day, 'yyyy-MM-dd') valido_desde", "if(o_orderkey % 3 <> 2, date_format(date_add(day, 90), 'yyyy-MM-dd'), null) valido_hasta",
            "if(o_orderkey % 3 = 0 or o_orderkey % 303 = 2, concat('/01-proyectos/p', 1 + (o_orderkey + 1) % 200, '/02-decisiones/dec-', o_orderkey + 1, '.md'), null) reemplazada_por", "o_custkey custkey",
        )

    def _src_pregunta(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "concat('01-proyectos/p', 1 + o_orderkey % 200, '/04-preguntas/q', o_orderkey, '.md') doc", "o_orderkey num", "concat('Pregunta ', o_orderkey) title", "o_orderpriority cuerpo", "concat('p', 1 + o_orderkey % 200) proyecto",
            "case o_orderstatus when 'O' then 'abierta' when 'P' then 'en-progreso' else 'respondida' end estado", f"case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then ' ' else {_PERSON.format('o_custkey')} end responsable",
            "cast(substr(o_orderpriority, 1, 1) in ('1', '2') as int) bloqueante", "date_format(o_orderdate, 'yyyy-MM-dd') created", f"if(o_orderstatus not in ('O', 'P') and o_orderkey % 50 <> 3, {_PERSON.format('1 + o_orderkey % 100')}, null) respondida_por",
        )

    def _src_lineamiento(self) -> DataFrame:
        rows = self.raw("supplier").join(self._nation, F.col("s_nationkey") == F.col("n_nationkey"))
        month = "lpad(cast(1 + s_suppkey % 12 as string), 2, '0')"
        return rows.selectExpr(
            "concat('02-areas/', area, '/lin-', s_suppkey, '.md') doc", "s_suppkey num", "concat('Lineamiento ', s_suppkey) title", "n_name cuerpo", "area", "concat('norma ', n_name) fuente", "if(s_suppkey % 5 = 0, 'en-revision', 'aprobado') estado",
            f"if(s_suppkey % 4 = 0, null, concat('2025-', {month}, '-10')) fecha", f"concat('2025-', {month}, '-15') valido_desde", f"if(s_suppkey % 3 = 0, null, concat('2026-', {month}, '-15')) valido_hasta",
            "if(s_suppkey % 6 in (1, 3), concat('/02-areas/', area, '/lin-', s_suppkey + 1, '.md'), null) reemplazada_por",
        )

    @cached_property
    def _talks(self) -> DataFrame:
        return self.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("docs"), F.sum((F.col("role") == "user").cast("int")).alias("completos"), F.sum(((F.col("role") == "assistant") & (F.length("text") > 200)).cast("int")).alias("citados"))

    def _src_reunion(self) -> DataFrame:
        return self._talks.selectExpr("concat('01-proyectos/p', 1 + conv_id % 200, '/01-reuniones/r', conv_id, '.md') doc", "conv_id num", "concat('Reunion ', conv_id) title", "concat(docs, ' turnos') cuerpo", "concat('p', 1 + conv_id % 200) proyecto", f"{_DAY.format('conv_id')} fecha")

    def _src_plan(self) -> DataFrame:
        return self.raw("part").selectExpr("concat('01-proyectos/p', p_partkey, '/PLAN.md') doc", "p_partkey num", "concat('Plan ', p_partkey) title", "p_brand cuerpo", "concat('p', p_partkey) proyecto", "if(p_partkey % 3 = 0, 'externa', 'cerebro') source_of_truth", "if(p_partkey % 3 = 0 and p_partkey % 90 <> 0, concat('https://tracker.example/', p_partkey), null) external_tracker", f"{_DAY.format('p_partkey')} last_review")

    def _src_diagrama(self) -> DataFrame:
        clase = _pick("p_partkey", "flujo", "proceso", "secuencia", "entidades", "organizacion", "arquitectura", "cronograma", "otro")
        return self.raw("part").selectExpr("concat('01-proyectos/p', 1 + p_partkey % 200, '/05-diagramas/g', p_partkey, '.md') doc", "p_partkey num", "concat('Diagrama ', p_partkey) title", "p_brand cuerpo", "concat('p', 1 + p_partkey % 200) proyecto", f"{clase} clase", "concat('v', lpad(cast(p_size as string), 2, '0')) version")

    def _src_playbook(self) -> DataFrame:
        return self.raw("supplier").selectExpr("concat('03-recursos/playbooks/b', s_suppkey, '.md') doc", "s_suppkey num", "concat('Playbook ', s_suppkey) title", "s_name cuerpo", "concat('p', 1 + s_suppkey % 200) proyecto")

    def _src_glosario(self) -> DataFrame:
        return self.raw("region").selectExpr("concat('03-recursos/glosario/', lower(r_name), '.md') doc", "cast(r_regionkey as bigint) num", "r_name title", "r_name cuerpo")

    def _src_analisis(self) -> DataFrame:
        return self.raw("documents").selectExpr("concat('01-proyectos/p', 1 + doc_id % 200, '/03-analisis/a', doc_id, '.md') doc", "doc_id num", "concat('Analisis ', doc_id) title", "text cuerpo", "concat('p', 1 + doc_id % 200) proyecto", f"{_DAY.format('doc_id')} fecha", "lang", "source")

    def _src_insumo(self) -> DataFrame:
        return self.raw("pages").selectExpr("concat('01-proyectos/p', 1 + page_id % 200, '/00-insumos/i', page_id, '.md') doc", "page_id num", "concat('Insumo ', page_id) title", "url cuerpo", "concat('p', 1 + page_id % 200) proyecto", "'html' formato", "if(page_id % 20 = 7, null, url) original")

    def source(self, kind: str) -> DataFrame:
        return getattr(self, f"_src_{kind.lower()}")()

    # ------------------------------------------------ the tables

    def _common(self, kind: str) -> DataFrame:
        """documentos' columns of one type, with its body and number."""
        floor = "case when num % 97 = 5 then 'public' when num % 2 = 0 then 'restricted' else 'confidential' end" if kind in ("Persona", "Insumo") else _pick("num", "internal", "public", "internal", "confidential", "internal", "restricted", "internal")
        return self.source(kind).selectExpr(
            "doc path", "sha2(concat(doc, '|', title), 256) hash", f"'{kind}' type", "title", "concat('Documento ', title) description", f"{floor} classification",
            "case num % 4 when 1 then concat('human:u', num % 50) when 2 then 'process:loader' when 3 then 'modelo/1' end generated_by", "if(num % 4 = 0, null, '2026-01-01T00:00:00Z') generated_at",
            "case when num % 11 = 0 then null when num % 5 = 0 then 'draft' when num % 5 = 4 then 'deprecated' else 'stable' end status",
            "if(num % 6 = 0, concat('2026-', lpad(cast(1 + num % 12 as string), 2, '0'), '-15T00:00:00Z'), null) stale_after", "substr(cuerpo, 1, 200) resumen", "sha2(cuerpo, 256) resumen_hash",
            f"{_pick('num', 'fuente', 'dialogo', 'inferido', 'manual', 'derivado')} procedencia", "cuerpo", "num key",
        )

    def texts(self, kind: str | None = None) -> list[tuple[DataFrame, dict[str, tuple[str, str]]]]:
        """key, path and texts of a type's documents (of each type's), with what search may know of columns that are made of others."""
        made = lambda k: {"title": (k, "key"), "description": (f"Documento {k}", "key")} if k in NUMBERED else {"description": ("Documento", "title")}
        return [(self._common(k).select("key", "path", "title", "description", "resumen", "cuerpo"), made(k)) for k in ([kind] if kind else TYPES)]

    def fields(self, kind: str) -> DataFrame:
        """A type's table with `key`, its documents' number: as good as their path in joins, which then exchange no texts."""
        return self.source(kind).select(F.col("num").alias("key"), *COLUMNS[kind.lower()].split())

    @cached_property
    def busqueda(self) -> DataFrame:
        """path and the texts that search reads."""
        return self.textos.drop("type")

    @cached_property
    def textos(self) -> DataFrame:
        return self._all.select("path", "type", "title", "description", "resumen", "cuerpo")

    @cached_property
    def _all(self) -> DataFrame:
        out = None
        for kind in TYPES:
            rows = self._common(kind).drop("key")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _index(self):
        """The place of the search index over these tables: another one when a table has been written since."""
        from ..operators.index import Index

        names = [f"{t}.parquet" for t in ("customer", "supplier", "part", "orders", "conversations", "region", "nation", "documents", "pages")]
        state = hashlib.sha256(f"{self.sf_dir}\n{stamp(self.spark, self.sf_dir, names)}".encode()).hexdigest()[:24]
        return Index(self.spark, f"{shared_dir(self.spark)}/tesela-index/{state}")

    @cached_property
    def index(self):
        """The stored search index, made when it is first asked for. Queries use it once it is there (`stored`), and don't make it."""
        return self.stored or self._index().build(self.textos.withColumnRenamed("type", "kind").withColumn("head", F.col("title")), ["kind", "head"])

    @property
    def stored(self):
        """The search index if it has been made of the tables as they are, else None."""
        index = self._index()
        return index if index.exists() else None

    def table(self, name: str) -> DataFrame:
        if name in COLUMNS:
            return self.source(name).select(*COLUMNS[name].split())
        return getattr(self, name)

    __getitem__ = table

    @cached_property
    def documentos(self) -> DataFrame:
        return self._all.drop("cuerpo")

    @cached_property
    def documentos_tags(self) -> DataFrame:
        of_text = self.source("Analisis").select("doc", F.posexplode(F.array("lang", "source")).alias("idx", "value")).filter("value is not null")
        of_playbooks = self.source("Playbook").withColumn("again", F.explode(F.expr("if(num % 10 = 4, array(0, 1), array(0))")))
        return of_text.unionByName(of_playbooks.selectExpr("doc", "0 idx", f"if(again = 1, 'otra', {_pick('num', 'erp', 'compras', 'ventas')}) value"))

    @cached_property
    def documentos_verified(self) -> DataFrame:
        rows = self.raw("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        return rows.selectExpr("concat('01-proyectos/p', 1 + doc_id % 200, '/03-analisis/a', if(doc_id % 25 = 7, 'x', ''), doc_id, '.md') doc", "0 idx", "if(quality = 1, concat('human:rev', doc_id % 9), 'process:auto') by", "'2026-02-01T00:00:00Z' at")

    @cached_property
    def documentos_sources(self) -> DataFrame:
        none = "cast(null as string)"
        of_text = self.source("Analisis").selectExpr("doc", "0 idx", "case when num % 50 = 0 then ' ' when num % 3 = 0 then concat('/01-proyectos/p', 1 + num % 200, '/CONTEXT.md') else concat('https://', source, '/', num) end resource", "source id", f"{none} title", f"{none} author", f"{none} last_modified")
        return of_text.unionByName(self.source("Lineamiento").selectExpr("doc", "0 idx", "concat('/01-proyectos/p', 1 + num % 200, '/CONTEXT.md') resource", f"{none} id", "fuente title", f"{none} author", "fecha last_modified"))

    @cached_property
    def decision_decisores(self) -> DataFrame:
        rows = self.source("Decision")
        first = rows.selectExpr("doc", "0 idx", f"if(num % 500 = 1, 'comite', {_PERSON.format('custkey')}) value")
        return first.unionByName(rows.filter("num % 2 = 0").selectExpr("doc", "1 idx", f"{_PERSON.format('1 + num % 100')} value"))

    def _listed(self, pairs: DataFrame, value: str) -> DataFrame:
        """pairs (partkey, k) as a list table of initiatives: positions by k."""
        from pyspark.sql.window import Window

        order = Window.partitionBy("partkey").orderBy("k")
        return pairs.distinct().withColumn("idx", F.row_number().over(order) - 1).selectExpr("concat('01-proyectos/p', partkey, '/CONTEXT.md') doc", "idx", f"{value} value")

    @cached_property
    def iniciativa_sistemas(self) -> DataFrame:
        return self._listed(self.raw("lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("k")), "concat('/03-recursos/sistemas/s', k, '.md')")

    @cached_property
    def iniciativa_personas(self) -> DataFrame:
        pairs = self.raw("lineitem").select("l_orderkey", "l_partkey").join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return self._listed(pairs.select(F.col("l_partkey").alias("partkey"), F.col("o_custkey").alias("k")), _PERSON.format("k"))

    @cached_property
    def reunion_asistentes(self) -> DataFrame:
        turns = self.raw("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
        return turns.selectExpr("concat('01-proyectos/p', 1 + conv_id % 200, '/01-reuniones/r', conv_id, '.md') doc", "cast(turn as int) idx", f"if(role = 'user', {_PERSON.format('1 + conv_id % 100')}, concat('rol:', role)) value")

    @cached_property
    def consultas(self) -> DataFrame:
        return self._talks.selectExpr("conv_id + 1 linea", f"{_DAY.format('conv_id')} fecha", "docs", "completos", "if(conv_id % 37 = 5, completos + 1, citados) citados", f"{_pick('conv_id', 'directa', 'explorar', 'sintesis')} modo", "cast(conv_id % 2 as int) archivada")
