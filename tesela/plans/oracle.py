"""The same tables, views and queries as DuckDB SQL, written apart from the DataFrame plans: what results are held against."""

from __future__ import annotations

_DAY = "'2026-' || lpad(cast(1 + {0} % 12 as varchar), 2, '0') || '-' || lpad(cast(1 + {0} % 28 as varchar), 2, '0')"
_C = "'/02-areas/personas/c' || ({}) || '.md'"


def _nth(key: str, *values: str) -> str:
    return f"(array[{', '.join('null' if v is None else repr(v) for v in values)}])[cast({key} % {len(values)} as int) + 1]"


#: Types as relations with doc, num, title, cuerpo and own fields.
_SOURCES = {
    "persona": f"""select '02-areas/personas/c' || c_custkey || '.md' doc, c_custkey num, c_name title, c_name cuerpo, c_mktsegment rol, n_name equipo,
        {_C.format("case when c_custkey % 150 = 7 then -1 when c_custkey % 200 = 0 then c_custkey + 10 when c_custkey % 200 = 10 then c_custkey - 10 when c_custkey % 10 <> 0 then c_custkey - c_custkey % 10 end")} reports_to
        from customer, nation where c_nationkey = n_nationkey""",
    "sistema": f"""select '03-recursos/sistemas/s' || s_suppkey || '.md' doc, s_suppkey num, s_name title, s_name cuerpo, case when s_suppkey % 2 = 0 then {_C.format("1 + s_suppkey % 100")} else n_name end owner,
        case when s_suppkey % 10 = 3 then 'otra' else {_nth("s_suppkey", "sistema", "herramienta", "producto", "proceso")} end categoria, {_nth("s_suppkey", "activo", "en-cambio", "deprecado")} estado from supplier, nation where s_nationkey = n_nationkey""",
    "iniciativa": f"""select '01-proyectos/p' || p_partkey || '/CONTEXT.md' doc, p_partkey num, p_name title, p_type cuerpo, 'p' || case when p_partkey % 500 = 3 then p_partkey - 1 else p_partkey end proyecto, {_nth("p_partkey", "proyecto-asignado", "objetivo-personal", "objetivo-equipo")} origen,
        case when p_partkey % 180 = 9 then 'Q' || (1 + p_size % 4) || '-2026' else '2026-Q' || (1 + p_size % 4) end periodo, {_nth("p_partkey", "iniciando", "en-progreso", "bloqueada", "entregada")} estado from part""",
    "decision": """select '01-proyectos/p' || (1 + o_orderkey % 200) || '/02-decisiones/dec-' || o_orderkey || '.md' doc, o_orderkey num, 'Decision ' || o_orderkey title, o_orderpriority cuerpo, 'p' || (1 + o_orderkey % 200) proyecto,
        case o_orderstatus when 'P' then 'propuesta' else 'aceptada' end estado, strftime(o_orderdate, '%Y-%m-%d') fecha, strftime(o_orderdate, '%Y-%m-%d') valido_desde,
        case when o_orderkey % 3 in (0, 1) then strftime(o_orderdate + interval 90 day, '%Y-%m-%d') end valido_hasta,
        case when o_orderkey % 3 = 0 or o_orderkey % 303 = 2 then '/01-proyectos/p' || (1 + (o_orderkey + 1) % 200) || '/02-decisiones/dec-' || (o_orderkey + 1) || '.md' end reemplazada_por, o_custkey custkey from orders""",
    "pregunta": f"""select '01-proyectos/p' || (1 + o_orderkey % 200) || '/04-preguntas/q' || o_orderkey || '.md' doc, o_orderkey num, 'Pregunta ' || o_orderkey title, o_orderpriority cuerpo, 'p' || (1 + o_orderkey % 200) proyecto,
        case when o_orderstatus = 'O' then 'abierta' when o_orderstatus = 'P' then 'en-progreso' else 'respondida' end estado, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then ' ' else {_C.format("o_custkey")} end responsable,
        case when left(o_orderpriority, 1) in ('1', '2') then 1 else 0 end bloqueante, strftime(o_orderdate, '%Y-%m-%d') created, case when o_orderstatus not in ('O', 'P') and o_orderkey % 50 <> 3 then {_C.format("1 + o_orderkey % 100")} end respondida_por from orders""",
    "lineamiento": """select '02-areas/' || lower(r_name) || '/lin-' || s_suppkey || '.md' doc, s_suppkey num, 'Lineamiento ' || s_suppkey title, n_name cuerpo, lower(r_name) area, 'norma ' || n_name fuente, case when s_suppkey % 5 = 0 then 'en-revision' else 'aprobado' end estado,
        case when s_suppkey % 4 <> 0 then '2025-' || m || '-10' end fecha, '2025-' || m || '-15' valido_desde, case when s_suppkey % 3 <> 0 then '2026-' || m || '-15' end valido_hasta,
        case when s_suppkey % 6 = 1 or s_suppkey % 6 = 3 then '/02-areas/' || lower(r_name) || '/lin-' || (s_suppkey + 1) || '.md' end reemplazada_por
        from (select *, lpad(cast(1 + s_suppkey % 12 as varchar), 2, '0') m from supplier) join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "reunion": f"""select '01-proyectos/p' || (1 + conv_id % 200) || '/01-reuniones/r' || conv_id || '.md' doc, conv_id num, 'Reunion ' || conv_id title, count(*) || ' turnos' cuerpo, 'p' || (1 + conv_id % 200) proyecto, {_DAY.format("conv_id")} fecha from conversations group by conv_id""",
    "plan": f"""select '01-proyectos/p' || p_partkey || '/PLAN.md' doc, p_partkey num, 'Plan ' || p_partkey title, p_brand cuerpo, 'p' || p_partkey proyecto, case when p_partkey % 3 = 0 then 'externa' else 'cerebro' end source_of_truth,
        case when p_partkey % 3 = 0 and p_partkey % 90 <> 0 then 'https://tracker.example/' || p_partkey end external_tracker, {_DAY.format("p_partkey")} last_review from part""",
    "diagrama": f"""select '01-proyectos/p' || (1 + p_partkey % 200) || '/05-diagramas/g' || p_partkey || '.md' doc, p_partkey num, 'Diagrama ' || p_partkey title, p_brand cuerpo, 'p' || (1 + p_partkey % 200) proyecto,
        {_nth("p_partkey", "flujo", "proceso", "secuencia", "entidades", "organizacion", "arquitectura", "cronograma", "otro")} clase, 'v' || lpad(cast(p_size as varchar), 2, '0') version from part""",
    "playbook": "select '03-recursos/playbooks/b' || s_suppkey || '.md' doc, s_suppkey num, 'Playbook ' || s_suppkey title, s_name cuerpo, 'p' || (1 + s_suppkey % 200) proyecto from supplier",
    "glosario": "select '03-recursos/glosario/' || lower(r_name) || '.md' doc, cast(r_regionkey as bigint) num, r_name title, r_name cuerpo from region",
    "analisis": f"select '01-proyectos/p' || (1 + doc_id % 200) || '/03-analisis/a' || doc_id || '.md' doc, doc_id num, 'Analisis ' || doc_id title, text cuerpo, 'p' || (1 + doc_id % 200) proyecto, {_DAY.format('doc_id')} fecha, lang, source from documents",
    "insumo": "select '01-proyectos/p' || (1 + page_id % 200) || '/00-insumos/i' || page_id || '.md' doc, page_id num, 'Insumo ' || page_id title, url cuerpo, 'p' || (1 + page_id % 200) proyecto, 'html' formato, case when page_id % 20 <> 7 then url end original from pages",
}
_OWN = {
    "analisis": "doc, proyecto, fecha", "decision": "doc, proyecto, estado, fecha, valido_desde, valido_hasta, reemplazada_por", "diagrama": "doc, proyecto, clase, version", "glosario": "doc", "iniciativa": "doc, proyecto, origen, periodo, estado", "insumo": "doc, proyecto, formato, original",
    "lineamiento": "doc, area, fuente, estado, fecha, valido_desde, valido_hasta, reemplazada_por", "persona": "doc, rol, equipo, reports_to", "plan": "doc, proyecto, source_of_truth, external_tracker, last_review", "playbook": "doc, proyecto",
    "pregunta": "doc, proyecto, estado, responsable, bloqueante, created, respondida_por", "reunion": "doc, proyecto, fecha", "sistema": "doc, owner, categoria, estado",
}


def _documents() -> str:
    arms = []
    for name in _SOURCES:
        kept = "case when num % 97 = 5 then 'public' when num % 2 = 0 then 'restricted' else 'confidential' end" if name in ("persona", "insumo") else _nth("num", "internal", "public", "internal", "confidential", "internal", "restricted", "internal")
        arms.append(f"select doc, num, title, cuerpo, '{name.capitalize()}' as type, {kept} classification from src_{name}")
    return f"""select doc as path, sha256(doc || '|' || title) hash, type, title, 'Documento ' || title description, classification,
        case when num % 4 = 1 then 'human:u' || num % 50 when num % 4 = 2 then 'process:loader' when num % 4 = 3 then 'modelo/1' end generated_by, case when num % 4 <> 0 then '2026-01-01T00:00:00Z' end generated_at,
        case when num % 11 <> 0 then case num % 5 when 0 then 'draft' when 4 then 'deprecated' else 'stable' end end status, case when num % 6 = 0 then '2026-' || lpad(cast(1 + num % 12 as varchar), 2, '0') || '-15T00:00:00Z' end stale_after,
        substring(cuerpo, 1, 200) resumen, sha256(cuerpo) resumen_hash, {_nth("num", "fuente", "dialogo", "inferido", "manual", "derivado")} procedencia, cuerpo from ({" union all ".join(arms)})"""


_DATED = [("analisis", "fecha"), ("decision", "fecha"), ("decision", "valido_desde"), ("decision", "valido_hasta"), ("lineamiento", "fecha"), ("lineamiento", "valido_desde"), ("lineamiento", "valido_hasta"), ("plan", "last_review"), ("pregunta", "created"), ("reunion", "fecha")]
_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_WORDS = "list_concat(list_concat({0}, {1}), list_concat({2}, {3}))".format(*(_TOKENS.format(c) for c in ("title", "description", "resumen", "cuerpo")))

_CTES = {f"src_{k}": v for k, v in _SOURCES.items()} | {k: f"select {_OWN[k]} from src_{k}" for k in _SOURCES} | {
    "todo": _documents(),
    "documentos": "select * exclude (cuerpo) from todo",
    "documentos_tags": f"select doc, 0 idx, lang as value from src_analisis where lang is not null union all select doc, 1, source from src_analisis where source is not null union all select doc, 0, {_nth('num', 'erp', 'compras', 'ventas')} from src_playbook union all select doc, 0, 'otra' from src_playbook where num % 10 = 4",
    "documentos_verified": "select '01-proyectos/p' || (1 + doc_id % 200) || '/03-analisis/a' || case when doc_id % 25 = 7 then 'x' else '' end || doc_id || '.md' doc, 0 idx, case when max(quality) = 1 then 'human:rev' || doc_id % 9 else 'process:auto' end as \"by\", '2026-02-01T00:00:00Z' as \"at\" from labels group by doc_id",
    "documentos_sources": """select doc, 0 idx, case when num % 50 = 0 then ' ' when num % 3 = 0 then '/01-proyectos/p' || (1 + num % 200) || '/CONTEXT.md' else 'https://' || source || '/' || num end resource, source id, cast(null as varchar) title, cast(null as varchar) author, cast(null as varchar) last_modified from src_analisis
        union all select doc, 0, '/01-proyectos/p' || (1 + num % 200) || '/CONTEXT.md', null, fuente, null, fecha from src_lineamiento""",
    "decision_decisores": f"select doc, 0 idx, case when num % 500 = 1 then 'comite' else {_C.format('custkey')} end as value from src_decision union all select doc, 1, {_C.format('1 + num % 100')} from src_decision where num % 2 = 0",
    "iniciativa_sistemas": "select '01-proyectos/p' || l_partkey || '/CONTEXT.md' doc, row_number() over (partition by l_partkey order by l_suppkey) - 1 idx, '/03-recursos/sistemas/s' || l_suppkey || '.md' as value from (select distinct l_partkey, l_suppkey from lineitem)",
    "iniciativa_personas": f"select '01-proyectos/p' || l_partkey || '/CONTEXT.md' doc, row_number() over (partition by l_partkey order by o_custkey) - 1 idx, {_C.format('o_custkey')} as value from (select distinct l_partkey, o_custkey from lineitem join orders on l_orderkey = o_orderkey)",
    "reunion_asistentes": f"select '01-proyectos/p' || (1 + conv_id % 200) || '/01-reuniones/r' || conv_id || '.md' doc, turn idx, case when min(role) = 'user' then {_C.format('1 + conv_id % 100')} else 'rol:' || min(role) end as value from conversations group by conv_id, turn",
    "consultas": f"select conv_id + 1 linea, {_DAY.format('conv_id')} fecha, count(*) docs, count(*) filter (role = 'user') completos, case when conv_id % 37 = 5 then count(*) filter (role = 'user') + 1 else count(*) filter (role = 'assistant' and length(text) > 200) end citados, {_nth('conv_id', 'directa', 'explorar', 'sintesis')} modo, conv_id % 2 archivada from conversations group by conv_id",
    "eventos": " union all ".join(f"select t.{f} fecha, '{n.capitalize()}' tipo, '{f}' campo, t.doc, title, {'null' if n == 'lineamiento' else 't.proyecto'} proyecto from {n} t join documentos on path = t.doc" for n, f in _DATED),
    "documento_proyecto": " union all ".join(f"select doc, proyecto from {n}" for n in ("analisis", "decision", "diagrama", "iniciativa", "insumo", "plan", "playbook", "pregunta", "reunion")),
    "vigencia": " union all ".join(f"select t.doc, '{n.capitalize()}' tipo, title, valido_desde, valido_hasta, reemplazada_por, estado, case when valido_hasta is null then 'vigente' when reemplazada_por is null then 'caducada' else 'reemplazada' end vigencia from {n} t join documentos on path = t.doc" for n in ("decision", "lineamiento")),
    "palabras": f"select path, {_WORDS} w from todo",
}


def with_tables(sql: str) -> str:
    return "with " + ", ".join(f"{name} as ({text})" for name, text in _CTES.items()) + " " + sql


def _bm25(term: str) -> str:
    """path and relevancia of the documents with one word."""
    return f"""select path, -(case when ln((total - hits + 0.5) / (hits + 0.5)) > 0 then ln((total - hits + 0.5) / (hits + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) relevancia
        from (select path, tf, size, count(*) over () total, avg(size) over () mean, count(*) filter (tf > 0) over () hits from (select path, len(list_filter(w, lambda x: x = '{term}')) tf, len(w) size from palabras)) where tf > 0"""


QUERIES = {
    "cq_21": "select title, responsable, proyecto from pregunta, documentos where path = doc and estado = 'abierta' and bloqueante = 1",
    "cq_22": "select title, created from pregunta, documentos where path = doc and estado = 'abierta' and date_diff('day', try_cast(created as date), date '{hoy}') > {dias}",
    "cq_35": "select title, proyecto from pregunta, documentos where path = doc and estado = 'abierta' and coalesce(trim(responsable), '') = ''",
    "cq_26": "select title, proyecto, created from pregunta, documentos where path = doc and responsable = '{persona}' and estado = 'abierta'",
    "cq_41": "select title, respondida_por from pregunta, documentos where path = doc and respondida_por = '{persona}' and estado = 'respondida'",
    "cq_23": "select path, type, title, generated_by from documentos where generated_by not ilike 'human:%' and path not in (select doc from documentos_verified where \"by\" ilike 'human:%')",
    "cq_24": "select path, title, stale_after from documentos where status = 'stable' and stale_after < '{ahora}'",
    "cq_37": "select path, type, title, classification from documentos where classification in ('confidential', 'restricted') and path in (select doc from documento_proyecto where proyecto = '{proyecto}')",
    "cq_52": "select procedencia, count(*) documentos, count(*) filter (path in (select doc from documentos_verified where \"by\" ilike 'human:%')) verificados_por_persona from documentos group by procedencia",
    "cq_27": "select t.title, fecha, resource from decision e join documentos t on path = e.doc left join documentos_sources s on s.doc = path where proyecto = '{proyecto}' and estado = 'aceptada' and valido_hasta is null",
    "cq_28": "select title, valido_hasta, reemplazada_por from decision, documentos where path = doc and proyecto = '{proyecto}' and valido_hasta is not null and reemplazada_por is not null",
    "cq_40": "select title, fecha from decision e join documentos on path = e.doc join decision_decisores w on w.doc = e.doc where value = '{persona}' and fecha >= '{desde}' and fecha <= '{hasta}'",
    "cq_34": "select type, title, periodo from documentos join documento_proyecto s on s.doc = path join (select proyecto, periodo from iniciativa where periodo < '{periodo}') i using (proyecto) where proyecto = '{proyecto}' and type in ('Analisis', 'Decision', 'Iniciativa')",
    "cq_29": "select title, estado, valido_hasta from decision, documentos where path = doc and estado = 'aceptada' and valido_hasta is null and doc in (select path from palabras where list_contains(w, '{asunto}'))",
    "cq_25": "select title, i.estado, coalesce(n, 0) bloqueantes from iniciativa i join documentos on path = i.doc left join (select proyecto, count(*) n from pregunta where estado = 'abierta' and bloqueante = 1 group by proyecto) q on q.proyecto = i.proyecto where periodo = '{periodo}'",
    "cq_36": "select title, last_review, source_of_truth from plan, documentos where path = doc and date_diff('day', cast(last_review as date), date '{hoy}') > {umbral}",
    "cq_42": "select title, via from (select doc, 'sistema' via from iniciativa_sistemas where value = '{sistema}' union all select doc, 'persona' from iniciativa_personas where value = '{persona}') x join iniciativa i using (doc) join documentos on path = x.doc",
    "cq_31": "select title, rol, equipo, reports_to, if(reports_to is null or rol is null, 'hueco', 'completo') ficha from persona, documentos where path = doc",
    "cq_39": "select title, categoria, estado from sistema, documentos where path = doc and owner in ('{persona}', '{equipo}')",
    "cq_32": "select type, title, rol from (select doc, 'asistente' rol from reunion_asistentes where value = '{persona}' union all select doc, 'decisor' from decision_decisores where value = '{persona}' union all select doc, 'implicada' from iniciativa_personas where value = '{persona}' union all select doc, 'sistema' from iniciativa_sistemas where value = '{sistema}') x, documentos where path = doc",
    "cq_33": "select title, fecha from reunion r, documentos where path = doc and (proyecto = '{proyecto}' or doc in (select doc from reunion_asistentes where value = '{persona}'))",
    "cq_30": "select title, area, fuente from lineamiento, documentos where path = doc and area = '{area}' and estado = 'aprobado' and coalesce(valido_hasta, '9') > '{hoy}'",
    "cq_38": "select clase, max(version) as version from diagrama where proyecto = '{proyecto}' group by clase",
    "cq_43": "select title, original, formato from insumo, documentos where path = doc and proyecto = '{proyecto}'",
    "cq_44": "select distinct title from playbook b, documentos where path = doc and status = 'stable' and (proyecto = '{proyecto}' or doc in (select doc from documentos_tags where value = '{tema}'))",
    "cq_45": "select count(*) consultas, count(*) filter (completos = 0) sin_abrir, round(count(*) filter (completos = 0) / nullif(count(*), 0)::double, 2) proporcion from consultas",
    "cq_46": "select round(avg(docs), 1) docs_vistos, round(avg(completos), 1) abiertos_enteros, round(avg(citados), 1) citados, round(sum(citados)::double / nullif(sum(completos), 0), 2) aprovechamiento from consultas",
    "cq_47": "select fecha, tipo, campo, title, doc from eventos where proyecto = '{proyecto}' and fecha between '{desde}' and '{hasta}'",
    "cq_48": "select tipo, title, doc, valido_desde, valido_hasta, reemplazada_por from vigencia where coalesce(valido_desde, '') <= '{fecha}' and coalesce(valido_hasta, '9') > '{fecha}'",
    "cq_51": "select tipo, title, doc, valido_hasta from vigencia where vigencia = 'caducada' and valido_hasta <= '{hoy}'",
    "cq_49": f"select path, type, title, round(relevancia, 6) relevancia from ({_bm25('{termino}')}) join documentos using (path) order by round(relevancia, 9), path limit 20",
    "cq_50": """select 'promovido' caso, d.type, d.title, d.path, s.resource origen from documentos_sources s join documentos d on d.path = s.doc join documento_proyecto p on s.resource = '/' || p.doc join iniciativa i on i.proyecto = p.proyecto and i.estado = 'entregada' where s.doc ilike '02-areas/%'
        union all select 'sin cosechar', 'Iniciativa', title, path, null from iniciativa i, documentos where path = doc and estado = 'entregada' and proyecto not in (select p.proyecto from documentos_sources s join documento_proyecto p on s.resource = '/' || p.doc where s.doc ilike '02-areas/%')""",
    "adv_03": "select doc, reports_to from persona where trim(reports_to) <> '' and ltrim(reports_to, '/') not in (select path from documentos)",
    "adv_04": "select path, title, stale_after from documentos where status = 'stable' and stale_after < '{ahora}'",
    "adv_05": "select path, type, classification from documentos where type in ('Persona', 'Insumo') and classification in ('public', 'internal')",
    "adv_06": "select doc, value from decision_decisores where ltrim(value, '/') not in (select path from documentos where type = 'Persona')",
    "adv_07": "select title, estado from decision, documentos where path = doc and estado = 'propuesta' and coalesce(valido_hasta, reemplazada_por) is not null",
    "adv_08": "select tipo, title, doc from vigencia where valido_hasta is null and reemplazada_por is not null",
    "adv_09": "select doc, \"by\" from documentos_verified where \"by\" not ilike 'human:%'",
    "adv_10": "select path, title, stale_after, status from documentos where stale_after < '{ahora}' and status in ('draft', 'stable')",
    "adv_11": "select a.doc persona_a, b.doc persona_b from persona a, persona b where ltrim(a.reports_to, '/') = b.doc and ltrim(b.reports_to, '/') = a.doc",
    "adv_12": "select doc, resource from documentos_sources where coalesce(trim(resource), '') = ''",
}

# ------------------------------------------------ search, rules, reports, derived tables, cost, integrity

_TYPE_TABLES = list(_SOURCES)
_CHILDREN = {"documentos_tags": "documentos", "documentos_verified": "documentos", "documentos_sources": "documentos", "decision_decisores": "decision", "iniciativa_sistemas": "iniciativa", "iniciativa_personas": "iniciativa", "reunion_asistentes": "reunion"}
_NEEDED = {
    "documentos": "hash type title description classification resumen resumen_hash procedencia", "analisis": "proyecto fecha", "decision": "proyecto estado fecha", "diagrama": "proyecto clase version", "iniciativa": "proyecto origen periodo estado", "insumo": "proyecto formato original", "lineamiento": "area fuente estado",
    "persona": "rol", "plan": "proyecto source_of_truth last_review", "playbook": "proyecto", "pregunta": "proyecto estado bloqueante created", "reunion": "proyecto fecha", "sistema": "owner categoria estado",
}
_ALLOWED = {
    ("documentos", "classification"): "public internal confidential restricted", ("documentos", "status"): "draft stable deprecated", ("documentos", "procedencia"): "fuente dialogo inferido manual derivado", ("decision", "estado"): "propuesta aceptada",
    ("diagrama", "clase"): "flujo proceso secuencia entidades organizacion arquitectura cronograma otro", ("iniciativa", "origen"): "proyecto-asignado objetivo-personal objetivo-equipo", ("iniciativa", "estado"): "iniciando en-progreso bloqueada entregada", ("insumo", "formato"): "pdf docx pptx xlsx html yaml",
    ("lineamiento", "estado"): "aprobado en-revision", ("plan", "source_of_truth"): "cerebro externa", ("pregunta", "estado"): "abierta en-progreso respondida", ("sistema", "categoria"): "sistema herramienta producto proceso", ("sistema", "estado"): "activo en-cambio deprecado",
}
_key = lambda t: "path" if t == "documentos" else "doc"

_PEOPLE = " union all ".join(
    [f"select doc, '{f}' field, {f} v from {t}" for t, f in (("pregunta", "responsable"), ("pregunta", "respondida_por"), ("sistema", "owner"), ("persona", "reports_to"))]
    + [f"select doc, '{f}', value from {t}" for t, f in (("decision_decisores", "decisores"), ("iniciativa_personas", "personas"), ("reunion_asistentes", "asistentes"))]
)
_RULES = {
    "rule_v15": "select path, stale_after what from documentos where coalesce(status, 'stable') = 'stable' and try_cast(stale_after as timestamptz) < timestamptz '{ahora}'",
    "rule_v16": "select path, 'below the floor' what from documentos where case classification when 'public' then 1 when 'internal' then 2 when 'confidential' then 3 else 4 end < case when type in ('Persona', 'Insumo') then 3 else 2 end",
    "rule_v20": "select doc as path, proyecto what from documento_proyecto where proyecto <> 'transversal' and proyecto not in (select proyecto from iniciativa)",
    "rule_v21": "select doc as path, periodo what from iniciativa where not regexp_full_match(periodo, '[0-9]{{4}}-(Q[1-4]|0[1-9]|1[0-2]|S[0-9]{{2}})')",
    "rule_v24": "select doc as path, 'inverted' what from vigencia where valido_hasta < valido_desde union all select doc, 'no end' from vigencia where reemplazada_por is not null and valido_hasta is null union all select a.doc, 'cycle' from vigencia a where exists (select 1 from vigencia b where '/' || b.doc = a.reemplazada_por and b.reemplazada_por = '/' || a.doc)",
    "rule_v25": "select path, type what from documentos where procedencia = 'fuente' and path not in (select doc from documentos_sources) and path not in (select doc from insumo where trim(original) <> '')",
    "rule_v07": "select doc as path, 'respondida_por' what from pregunta where estado = 'respondida' and coalesce(trim(respondida_por), '') = '' union all select doc, 'external_tracker' from plan where source_of_truth = 'externa' and coalesce(trim(external_tracker), '') = ''",
}
_FOUND = " union all ".join(f"select '{r[5:].upper()}' as \"check\", path, what from ({sql})" for r, sql in _RULES.items())

QUERIES |= _RULES | {
    "chk_not_null": " union all ".join(f"select 'not_null' as \"check\", '{t}' tabla, '{c}' columna, {_key(t)} doc from {t} where {c} is null" for t, cs in _NEEDED.items() for c in cs.split()),
    "chk_enum": " union all ".join(f"select 'enum' as \"check\", '{t}' tabla, '{c}' columna, {_key(t)} doc from {t} where {c} not in ({', '.join(map(repr, vs.split()))})" for (t, c), vs in _ALLOWED.items()),
    "chk_pk": " union all ".join([f"select 'pk' as \"check\", '{t}' tabla, '{_key(t)}' columna, {_key(t)} doc from {t} group by {_key(t)} having count(*) > 1" for t in ["documentos", *_TYPE_TABLES]] + [f"select 'pk', '{t}', 'idx', doc from {t} group by doc, idx having count(*) > 1" for t in _CHILDREN]),
    "chk_unique": "select 'unique' as \"check\", 'iniciativa' tabla, 'proyecto' columna, doc from iniciativa a where exists (select 1 from iniciativa b where b.proyecto = a.proyecto and b.doc < a.doc)",
    "chk_fk": " union all ".join([f"select 'fk' as \"check\", '{t}' tabla, 'doc' columna, doc from {t} where doc not in (select path from documentos)" for t in _TYPE_TABLES] + [f"select 'fk', '{t}', 'doc', doc from {t} where doc not in (select {_key(p)} from {p})" for t, p in _CHILDREN.items()]),
    "fts_match": "select path from palabras where list_contains(w, '{termino}')",
    "fts_prefix": "select path from palabras where len(list_filter(w, lambda x: starts_with(x, 'urg'))) > 0",
    "fts_column": f"select path from todo where list_contains({_TOKENS.format('title').replace('{', '{{').replace('}', '}}')}, 'pregunta') and path not in (select path from palabras where list_contains(w, 'urgent'))",
    "fts_phrase": "select path from todo where " + " or ".join(f"contains(' ' || array_to_string({_TOKENS.format(c).replace('{', '{{').replace('}', '}}')}, ' ') || ' ', ' of the ')" for c in ("title", "description", "resumen", "cuerpo")),
    "fts_topk": f"select path, round(relevancia, 6) relevancia from ({_bm25('{termino}')}) order by round(relevancia, 9), path limit 10",
    "fts_postings": "select term, path, field, count(*) tf from (" + " union all ".join(f"select path, '{c}' field, unnest({_TOKENS.format(c).replace('{', '{{').replace('}', '}}')}) term from todo" for c in ("title", "description", "resumen", "cuerpo")) + ") group by all",
    "fts_terms": f"select term, count(distinct path) docs, count(*) tf from (select path, unnest(list_concat({_TOKENS.format('title').replace('{', '{{').replace('}', '}}')}, {_TOKENS.format('description').replace('{', '{{').replace('}', '}}')})) term from documentos) group by term",
    "rule_v17": f"select field, state, count(*) n from (select field, case when v not like '/%' then 'free text' when type is null then 'missing' when type <> 'Persona' then type end state from ({_PEOPLE}) left join documentos on path = substr(v, 2) and v like '/%' where trim(v) <> '') where state is not null group by field, state",
    "rule_v26": "select linea, citados, completos from consultas where citados > completos",
    "gov_classification_mix": "select type, classification, n, cast(floor(100 * n / sum(n) over (partition by type)) as bigint) pct from (select type, classification, count(*) n from documentos group by type, classification)",
    "gov_trust": "select count(*) documents, count(*) filter (ok) confirmed, count(*) filter (agent) by_agents, count(*) filter (agent and not ok) by_agents_unconfirmed from (select path in (select doc from documentos_verified where \"by\" ilike 'human:%') ok, coalesce(generated_by not ilike 'human:%', false) agent from documentos)",
    "gov_lifecycle": "select coalesce(status, '-') status, count(*) n, count(*) filter (stale_after < '{ahora}') stale from documentos group by 1",
    "findings_summary": f"select \"check\", count(*) n from ({_FOUND}) group by 1",
    "findings_top_n": f"select \"check\", rank, path, what, greatest(n - 8, 0) more from (select *, row_number() over (partition by \"check\" order by path, what) rank, count(*) over (partition by \"check\") n from ({_FOUND})) where rank <= 8",
    "derive_open_questions": "select '[' || d.title || '](/' || q.doc || ')' pregunta, q.proyecto, coalesce(o.title, trim(responsable), '') responsable, bloqueante, date_diff('day', cast(created as date), date '{hoy}') dias from pregunta q join documentos d on d.path = q.doc left join documentos o on o.path = ltrim(trim(responsable), '/') where estado = 'abierta'",
    "derive_goals_grouped": "select g, origen, row_number() over (partition by g order by periodo, title, doc) pos, title, periodo, estado from (select *, coalesce(list_position(['proyecto-asignado', 'objetivo-personal', 'objetivo-equipo'], origen), 99) g from iniciativa, documentos where path = doc)",
    "derive_org_nodes": "select regexp_replace(doc, '[^A-Za-z0-9_]', '_', 'g') id, title, rol from persona, documentos where path = doc",
    "derive_org_edges": "select regexp_replace(a.doc, '[^A-Za-z0-9_]', '_', 'g') a, regexp_replace(b.doc, '[^A-Za-z0-9_]', '_', 'g') b from persona a join persona b on b.doc = ltrim(a.reports_to, '/')",
    "derive_org_gaps": "select doc, title from persona, documentos where path = doc and coalesce(trim(reports_to), '') = ''",
    "index_by_directory": """select l.dir, docs, coalesce(subdirs, 0) subdirs, digest from (select dir, count(*) docs, cast(sum(cast('0x' || substr(md5('* [' || title || '](' || file || ') - ' || description), 1, 8) as bigint)) as bigint) digest from (select regexp_extract(path, '^(.*)/[^/]*$', 1) dir, split_part(path, '/', -1) file, title, description from documentos) group by dir) l
        left join (select regexp_extract(dir, '^(.*)/[^/]*$', 1) dir, count(*) subdirs from (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) dir from documentos) group by 1) b on b.dir = l.dir""",
    "survey_types": "select type, count(*) n, sum(length(cuerpo) // 4) tokens from todo group by type",
    "survey_totals": "select count(*) docs, sum(length(cuerpo) // 4) tokens, max(length(cuerpo) // 4) largest, max(len(string_split(path, '/'))) depth from todo",
    "survey_cost": "select sum(2 * t) derived, sum(t) filter (r <= 5) top5, count(*) docs, case when count(*) < 200 then 'unreliable' else 'measured' end verdict from (select length(cuerpo) // 4 t, row_number() over (order by length(cuerpo) // 4 desc, path) r from todo)",
    "survey_link_classes": "select case when contains(l, '://') then 'external' when path is not null then 'bundle' when l like '/%' then 'missing' else 'relative' end kind, count(*) n from (select trim(resource) l from documentos_sources union all select reemplazada_por from decision union all select reemplazada_por from lineamiento) left join documentos on '/' || path = l where l <> '' group by 1",
    "raw_manifest_check": """select case when s.doc is null then 'orphan' when r.doc is null then 'missing' when stated = '' then 'no hash' when stated = r.hash then 'ok' else 'changed' end state, count(*) n
        from (select case when n = 1 then doc || '.old' else doc end doc, case when n = 2 then '' when n = 3 then reverse(hash) else hash end stated from (select doc, num % 10 n, sha256(doc || '|' || title) hash from src_insumo) where n <> 0) s
        full join (select doc, sha256(doc || '|' || title) hash from src_insumo) r on r.doc = s.doc group by 1""",
    "diff_new_changed_gone": """select case when b.path is null then 'new' when a.path is null then 'gone' when a.hash = b.hash then 'same' else 'changed' end state, count(*) n from documentos a
        full join (select case when n = 1 then path || '.old' else path end path, case when n = 2 then 'x' else hash end hash from (select path, hash, length(title) % 4 n from documentos) where n <> 0) b on b.path = a.path group by 1""",
    "survey_verdict": """select docs, tokens, depth, 2 * tokens derived, indexes, navigation, reading, 2 * tokens + indexes upkeep, navigation + reading asking,
        case when docs < 200 then 'unreliable' when 2 * tokens + indexes > 2 * (navigation + reading) then 'upkeep' when navigation + reading > 2 * (2 * tokens + indexes) then 'asking' else 'comparable' end verdict
        from (select docs, tokens, depth, cast(floor(8 * mean) as bigint) indexes, cast(floor(8 * roots + mean * greatest(depth - 1, 1)) as bigint) navigation, reading from
        (select count(*) docs, cast(sum(t) as bigint) tokens, max(len(string_split(path, '/'))) depth, cast(sum(t) filter (r <= 5) as bigint) reading from (select path, t, row_number() over (order by t desc, path) r from (select path, length(coalesce(cuerpo, '')) // 4 t from todo))),
        (select avg(i) mean, count(distinct split_part(dir, '/', 1)) roots from (select regexp_extract(path, '^(.*)/[^/]*$', 1) dir, sum(length(title) + length(description) + length(split_part(path, '/', -1)) + 9) // 4 i from todo group by 1)))""",
    "survey_fields": " union all ".join(f"select '{t}' as type, '{c}' field, (select count(*) from {t}) docs, (select count({c}) from {t}) n" for t, cs in _OWN.items() for c in cs.split(", ") if c != "doc"),
    "gov_personal": "select type, classification, count(*) n, count(*) filter (classification in ('public', 'internal')) exposed from documentos where type = 'Persona' group by all",
    "gov_stewardship": "select type, coalesce(\"by\", '-') steward, count(*) n from documentos left join (select distinct doc, \"by\" from documentos_verified where \"by\" like 'human:%') on doc = path group by all",
    "gov_unset": "select type, count(*) n, count(*) - count(status) no_status, count(*) - count(generated_by) no_maker, count(*) - count(stale_after) no_date, count(*) filter (status = 'deprecated') deprecated from documentos group by type",
    "archive_periods": "select periodo, count(*) n from iniciativa where estado = 'entregada' group by periodo",
    "org_depth": "select doc, depth from (with recursive d as (select doc, 0 depth from persona where coalesce(trim(reports_to), '') = '' union all select p.doc, depth + 1 from persona p join d on ltrim(p.reports_to, '/') = d.doc) select * from d)",
    "content_sha256": "select path, sha256(cuerpo) sha256 from todo",
    "place_documents": """select type, regexp_full_match(regexp_extract(path, '^(.*)/[^/]*$', 1), case type when 'Iniciativa' then '01-proyectos/[^/]+' when 'Plan' then '01-proyectos/[^/]+' when 'Insumo' then '01-proyectos/[^/]+/00-insumos' when 'Reunion' then '01-proyectos/[^/]+/01-reuniones' when 'Decision' then '01-proyectos/[^/]+/02-decisiones'
        when 'Analisis' then '01-proyectos/[^/]+/03-analisis' when 'Pregunta' then '01-proyectos/[^/]+/04-preguntas' when 'Diagrama' then '01-proyectos/[^/]+/05-diagramas' when 'Persona' then '02-areas/personas' when 'Lineamiento' then '02-areas/[^/]+' when 'Sistema' then '03-recursos/sistemas' when 'Playbook' then '03-recursos/playbooks' else '03-recursos/glosario' end) placed, count(*) n from documentos group by 1, 2""",
}
