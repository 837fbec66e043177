"""The contract of the corpus model: types, fields and what each field may hold. All else (schemas, tables, rules, templates) is generated from it.

The shapes of actors, log lines, periods and locations are choices of this library; those of tables and enums are the model's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ["public", "internal", "confidential", "restricted"]


@dataclass(frozen=True)
class Field:
    kind: str = "text"
    required: bool = False
    values: tuple[str, ...] = ()
    of: str | None = None
    members: tuple[tuple[str, bool], ...] = ()
    target: str | None = None
    severity: str = "error"
    max_chars: int = 200
    default: str | None = None


def _enum(*values: str, required: bool = True, default: str | None = None) -> Field:
    return Field("enum", required, values, default=default)


_TEXT, _NEED, _DATE = Field(), Field(required=True), Field("date")
_NEED_DATE, _PERSON, _LIST = Field("date", True), Field("person-ref"), Field("list", of="text")

#: Fixed values of the model: fields that all types have, and each type's own.
COMMON = {
    "type": _NEED, "title": _NEED, "description": Field("sentence", True), "tags": Field("list", True, of="text"), "classification": _enum(*LEVELS), "generated": Field("map", members=(("by", False), ("at", False))), "verified": Field("list", of="map", members=(("by", True), ("at", True))),
    "sources": Field("list", of="map", members=(("resource", True), ("id", False), ("title", False), ("author", False), ("last_modified", False))), "status": _enum("draft", "stable", "deprecated", required=False), "stale_after": Field("datetime"), "resumen": _NEED, "resumen_hash": _NEED,
    "procedencia": _enum("fuente", "dialogo", "inferido", "manual", "derivado", default="manual"),
}
_VALID = {"valido_desde": _DATE, "valido_hasta": _DATE, "reemplazada_por": Field("link")}
_PROJECT = Field("type-key", True, target="Iniciativa", default="transversal")
TYPES = {
    "Analisis": {"proyecto": _PROJECT, "fecha": _NEED_DATE},
    "Decision": {"proyecto": _PROJECT, "estado": _enum("propuesta", "aceptada", default="propuesta"), "fecha": _NEED_DATE, **_VALID, "decisores": Field("list", of="person-ref")},
    "Diagrama": {"proyecto": _PROJECT, "clase": _enum("flujo", "proceso", "secuencia", "entidades", "organizacion", "arquitectura", "cronograma", "otro", default="flujo"), "version": _NEED},
    "Glosario": {},
    "Iniciativa": {"proyecto": _NEED, "origen": _enum("proyecto-asignado", "objetivo-personal", "objetivo-equipo"), "periodo": _NEED, "estado": _enum("iniciando", "en-progreso", "bloqueada", "entregada", default="iniciando"), "sistemas": Field("list", of="link"), "personas": Field("list", of="person-ref")},
    "Insumo": {"proyecto": _PROJECT, "formato": _enum("pdf", "docx", "pptx", "xlsx", "html", "yaml", default="pdf"), "original": Field("link", True)},
    "Lineamiento": {"area": _NEED, "fuente": _NEED, "estado": _enum("aprobado", "en-revision", default="aprobado"), "fecha": _DATE, **_VALID},
    "Persona": {"rol": _NEED, "equipo": _TEXT, "reports_to": Field("typed-ref", target="Persona")},
    "Plan": {"proyecto": _PROJECT, "source_of_truth": _enum("cerebro", "externa", default="cerebro"), "external_tracker": Field("link"), "last_review": _NEED_DATE},
    "Playbook": {"proyecto": _PROJECT},
    "Pregunta": {"proyecto": _PROJECT, "estado": _enum("abierta", "en-progreso", "respondida", default="abierta"), "responsable": _PERSON, "bloqueante": Field("boolean", True, default="false"), "created": _NEED_DATE, "respondida_por": _PERSON},
    "Reunion": {"proyecto": _PROJECT, "fecha": _NEED_DATE, "asistentes": Field("list", of="person-ref")},
    "Sistema": {"owner": Field("person-ref", True), "categoria": _enum("sistema", "herramienta", "producto", "proceso", default="sistema"), "estado": _enum("activo", "en-cambio", "deprecado", default="activo")},
}
FLOORS = {"Persona": "confidential", "Insumo": "confidential"}
#: Choices of this library.
PLACES = {
    "Iniciativa": ["01-proyectos/{proyecto}"], "Plan": ["01-proyectos/{proyecto}"], "Insumo": ["01-proyectos/{proyecto}/00-insumos"], "Reunion": ["01-proyectos/{proyecto}/01-reuniones"], "Decision": ["01-proyectos/{proyecto}/02-decisiones", "02-areas/decisiones"], "Analisis": ["01-proyectos/{proyecto}/03-analisis"],
    "Pregunta": ["01-proyectos/{proyecto}/04-preguntas"], "Diagrama": ["01-proyectos/{proyecto}/05-diagramas"], "Persona": ["02-areas/personas"], "Lineamiento": ["02-areas/{area}"], "Sistema": ["03-recursos/sistemas"], "Playbook": ["03-recursos/playbooks"], "Glosario": ["03-recursos/glosario"],
}
ARCHIVE = "04-archivo/{periodo}/{proyecto}"
ACTORS = [r"human:[A-Za-z0-9._-]+", r"process:[A-Za-z0-9._-]+", r"[A-Za-z0-9._-]+/[A-Za-z0-9._-]+"]
PERIODS = {"trimestre": r"\d{4}-Q[1-4]", "mes": r"\d{4}-(0[1-9]|1[0-2])", "sprint": r"\d{4}-S\d{2}"}
SCHEMA = "schema/"
RESERVED = {"index.md": "index", "log.md": "log", "log-consultas.md": "query-log"}
EXEMPT = {"PERFIL.md"}
#: (type, when, fields that are needed then). A `when` has for each field a value, a list of values, or {"not": either}; all must hold.
CONDITIONS = [("Pregunta", {"estado": "respondida"}, ["respondida_por"]), ("Plan", {"source_of_truth": {"not": ["cerebro"]}}, ["external_tracker"])]
#: Types whose documents are about persons, and the roles that see a type in some places alone.
PERSONAL = {"Persona"}
ROLES = {"Iniciativa": {"activas": ["01-proyectos/{proyecto}"], "archivo": ["04-archivo/{periodo}/{proyecto}"]}}
SENTINELS = {"transversal"}
LOG_LINE = r"^- (?<q>.+) — (?<docs>\d+) docs \((?<completos>\d+) completos, (?<citados>\d+) citados\) · (?<modo>[\w-]+) · (?<archivada>archivada|no)$"
CITATIONS = "Citations"


class ContractError(ValueError):
    pass


def holds(when: dict, value: Callable[[str], Column]) -> Column:
    """The condition that a `when` stands for; value gives the column of a field. A field without a value fits nothing but a `not`."""
    out = F.lit(True)
    for name, wanted in when.items():
        negated = isinstance(wanted, dict)
        if negated and set(wanted) != {"not"}:
            raise ContractError(f"when {name}: {wanted}")
        values = wanted["not"] if negated else wanted
        fits = F.coalesce(value(name).isin(*(values if isinstance(values, list) else [values])), F.lit(False))
        out = out & (~fits if negated else fits)
    return out


@dataclass
class Contract:
    types: dict[str, dict[str, Field]] = field(default_factory=lambda: {k: dict(v) for k, v in TYPES.items()})
    common: dict[str, Field] = field(default_factory=lambda: dict(COMMON))
    places: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in PLACES.items()})
    period: str | None = None
    conditions: list[tuple] = field(default_factory=lambda: list(CONDITIONS))
    floors: dict[str, str] = field(default_factory=lambda: dict(FLOORS))
    actors: list[str] = field(default_factory=lambda: list(ACTORS))
    roles: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {k: dict(v) for k, v in ROLES.items()})

    def fields(self, kind: str) -> dict[str, Field]:
        return self.common | self.types.get(kind, {})

    def extended(self, text: str) -> Contract:
        """With a bundle's own choices and additions, as JSON.

        Added: {"types": {name: {"fields": {..}, "places": [..], "roles": {..}, "floor": level}}, "conditions": [[type, when, [fields]]], "actors":
        [pattern]}; base types can't be redefined. Chosen, each one of those declared: {"period": name, "floors": {type: level}}; a floor may
        only rise."""
        extra = json.loads(text)
        if odd := set(extra) - {"types", "period", "floors", "conditions", "actors"}:
            raise ContractError(f"unknown keys: {', '.join(sorted(odd))}")
        if (period := extra.get("period")) not in (None, *PERIODS):
            raise ContractError(f"no period format {period}")
        added = extra.get("types", {})
        if twice := set(added) & set(self.types):
            raise ContractError(f"redefined: {', '.join(sorted(twice))}")
        for name, spec in added.items():
            if odd := set(spec) - {"fields", "places", "roles", "floor"}:
                raise ContractError(f"{name}: unknown keys: {', '.join(sorted(odd))}")
        fields = lambda spec: {f: Field(**{a: tuple(b) if isinstance(b, list) else b for a, b in x.items()}) for f, x in spec.get("fields", {}).items()}
        types = self.types | {k: fields(v) for k, v in added.items()}
        floors = self.floors | {k: v["floor"] for k, v in added.items() if "floor" in v}
        for k, level in (extra.get("floors", {}) | {k: floors[k] for k in added if k in floors}).items():
            if k not in types or level not in LEVELS:
                raise ContractError(f"no floor {level} of {k}")
            if LEVELS.index(level) < LEVELS.index(self.floors.get(k, "internal")):
                raise ContractError(f"the floor of {k} is {self.floors.get(k, 'internal')}")
            floors[k] = level
        conditions = [(k, when, list(need)) for k, when, need in extra.get("conditions", [])]
        for k, when, need in conditions:
            if k not in types or not {*when, *need} <= {*self.common, *types[k]}:
                raise ContractError(f"a condition of fields that {k} has not")
            holds(when, lambda n: F.lit(n))
        for actor in extra.get("actors", []):
            re.compile(actor)
        own = lambda key: {k: v[key] for k, v in added.items() if key in v}
        return Contract(types, self.common, self.places | own("places"), period or self.period, self.conditions + conditions, floors, self.actors + extra.get("actors", []), self.roles | own("roles"))

    @cached_property
    def period_shape(self) -> str:
        return "^(" + (PERIODS[self.period] if self.period else "|".join(PERIODS.values())) + ")$"

    @staticmethod
    def _shape(place: str) -> str:
        """A place as a regular expression, any folder in its holes."""
        return re.sub(r"\\\{\w+\\\}", "[^/]+", re.escape(place))

    def role_shapes(self, kind: str, role: str) -> list[str]:
        """Regular expressions for the folders in which a role sees a type: all that it may be in, where none are named for the role."""
        named = self.roles.get(kind, {})
        if named and role not in named:
            raise ContractError(f"{kind} has no role {role}")
        return [f"^{self._shape(p)}$" for p in named[role]] if named else self.place_shapes(kind)

    def place_shapes(self, kind: str) -> list[str]:
        """Regular expressions for the folders of a type, archived ones included."""
        hole = self._shape
        own = [hole(p) for p in self.places.get(kind, [])]
        moved = [hole(ARCHIVE) + hole(p).removeprefix(hole("01-proyectos/{proyecto}")) for p in self.places.get(kind, []) if p.startswith("01-proyectos/{proyecto}")]
        return [f"^{p}$" for p in own + moved]

    # ------------------------------------------------ generated

    def json_struct(self, kind: str) -> T.StructType:
        """What from_json reads of a document's front matter, lists and maps brought to their shape before."""
        def data(f: Field) -> T.DataType:
            if f.kind == "list":
                return T.ArrayType(T.StructType([T.StructField(m, T.StringType()) for m, _ in f.members]) if f.of == "map" else T.StringType())
            if f.kind == "map":
                return T.StructType([T.StructField(m, T.StringType()) for m, _ in f.members])
            return T.StringType()

        return T.StructType([T.StructField(n, data(f)) for n, f in self.fields(kind).items()])

    def columns(self, kind: str | None) -> dict[str, tuple[T.DataType, bool]]:
        """The columns of a type's table, or of documentos: name to (type, nullable)."""
        if kind is None:
            out = {"path": (T.StringType(), False), "hash": (T.StringType(), False)}
            for n, f in self.common.items():
                if f.kind == "map":
                    out |= {f"{n}_{m}": (T.StringType(), True) for m, _ in f.members}
                elif f.kind != "list":
                    out[n] = (T.StringType(), not f.required)
            return out
        own = {n.lower().replace("-", "_"): (T.IntegerType() if f.kind == "boolean" else T.StringType(), not f.required) for n, f in self.types[kind].items() if f.kind != "list"}
        return {"doc": (T.StringType(), False)} | own

    def lists(self, kind: str | None) -> dict[str, Field]:
        return {n: f for n, f in (self.common if kind is None else self.types[kind]).items() if f.kind == "list"}

    def struct(self, kind: str | None) -> T.StructType:
        return T.StructType([T.StructField(n, t, null) for n, (t, null) in self.columns(kind).items()])

    def template(self, kind: str) -> str:
        """An empty document of a type."""
        def value(f: Field) -> str:
            if f.default:
                return f.default
            if f.kind == "enum":
                return " | ".join(f.values)
            return {"list": "[]", "map": "{" + ", ".join(f"{m}: <{m}>" for m, _ in f.members) + "}", "date": "<YYYY-MM-DD>", "boolean": "false"}.get(f.kind, "<...>")

        lines = [f"type: {kind}"] + [f"{n}: {self.floors.get(kind, 'internal') if n == 'classification' else value(f)}" for n, f in self.fields(kind).items() if n != "type" and (f.required or n == "generated")]
        return "---\n" + "\n".join(lines) + "\n---\n"

    def json_schema(self, kind: str) -> dict:
        """The type's front matter as a JSON schema; items of lists of maps keep their members."""
        def shape(f: Field) -> dict:
            if f.kind == "list":
                return {"type": "array", "items": members(f) if f.of == "map" else {"type": "string"}}
            if f.kind == "map":
                return members(f)
            return {"enum": {"type": "string", "enum": list(f.values)}, "boolean": {"type": "boolean"}, "date": {"type": "string", "format": "date"}, "datetime": {"type": "string", "format": "date-time"}}.get(f.kind, {"type": "string"})

        def members(f: Field) -> dict:
            return {"type": "object", "properties": {m: {"type": "string"} for m, _ in f.members}, "required": [m for m, need in f.members if need]}

        fields = self.fields(kind)
        return {"title": kind, "type": "object", "properties": {n: shape(f) for n, f in fields.items()}, "required": [n for n, f in fields.items() if f.required]}

    def place(self, kind: str, values: dict[str, str]) -> list[str]:
        """The folders that a new document of a type may go to, with all their holes filled from values."""
        return [p.format(**values) for p in self.places.get(kind, []) if set(re.findall(r"\{(\w+)\}", p)) <= set(values)]

    def tables(self) -> dict[str, T.StructType]:
        """Every table with its columns: documentos, the types, their lists, the query log."""
        out = {"documentos": self.struct(None)}
        for kind in (None, *self.types):
            if kind is not None:
                out[kind.lower()] = self.struct(kind)
            for n, f in self.lists(kind).items():
                members = [T.StructField(m, T.StringType(), not need) for m, need in f.members] if f.of == "map" else [T.StructField("value", T.StringType(), False)]
                out[f"{(kind or 'documentos').lower()}_{n}"] = T.StructType([T.StructField("doc", T.StringType(), False), T.StructField("idx", T.IntegerType(), False), *members])
        log = [T.StructField(n, T.IntegerType() if n in ("linea", "docs", "completos", "citados", "archivada") else T.StringType(), False) for n in ("linea", "fecha", "docs", "completos", "citados", "modo", "archivada")]
        return out | {"consultas": T.StructType(log)}

    def ddl(self) -> str:
        """The tables as statements of Spark SQL."""
        return "\n\n".join(f"CREATE TABLE IF NOT EXISTS {name} (\n  " + ",\n  ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" + " NOT NULL" * (not f.nullable) for f in fields) + "\n) USING parquet;" for name, fields in self.tables().items()) + "\n"

    def artifacts(self) -> dict[str, str]:
        """The generated files of a bundle's schema folder: path to text."""
        out = {"schema/ddl.sql": self.ddl(), "schema/model.md": self.document()}
        for k in self.types:
            out[f"schema/templates/{k.lower()}.md"] = self.template(k)
            out[f"schema/json/{k.lower()}.schema.json"] = json.dumps(self.json_schema(k), ensure_ascii=False, indent=2, sort_keys=True) + "\n"
        return out

    def document(self) -> str:
        """The whole contract as one Markdown text, for readers without this library."""
        def row(name: str, f: Field) -> str:
            what = {"enum": ", ".join(f.values), "list": f"of {f.of}" + (f" ({', '.join(m for m, _ in f.members)})" if f.members else ""), "map": ", ".join(m for m, _ in f.members)}.get(f.kind, f.target or "")
            return f"| {name} | {f.kind} | {'yes' if f.required else ''} | {what} | {f.default or ''} |"

        head = ["| field | kind | needed | values | default |", "|---|---|---|---|---|"]
        parts = ["# Model of the corpus", "## All types", "\n".join(head + [row(n, f) for n, f in self.common.items()])]
        for k, fields in self.types.items():
            parts.append(f"## {k}")
            parts.append(f"Places: {', '.join(f'`{p}`' for p in self.places.get(k, [])) or 'any'}. At least {self.floors.get(k, 'internal')}." + " About persons." * (k in PERSONAL))
            parts += ["\n".join(head + [row(n, f) for n, f in fields.items()])] if fields else []
            parts += [f"Where {json.dumps(when, ensure_ascii=False)}: {', '.join(need)} needed." for t, when, need in self.conditions if t == k]
        parts += ["## Shapes", "\n".join(f"* {n}: `{p}`" for n, p in [*(("actor", a) for a in self.actors), *((f"period {n}", p) for n, p in PERIODS.items())])]
        return "\n\n".join(parts) + "\n"
