"""The SQL each query is checked against, in DuckDB's dialect over the same tables.

Nothing here is imported from the operators: words, patterns and weights are written out once more, so that one that is
wrong there is seen.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# Fixed values, as the operators must have them.
TAG_WORDS = {
    "API": "api endpoint route handler view", "DATABASE": "db database model table sql query", "UTILITY": "util helper common shared", "CONFIG": "config setting env constant",
    "TEST": "test mock fixture", "SERVICE": "service client manager", "EXCEPTION": "error exception raise", "ASYNC": "async await coroutine",
}
PRIORITY_WORDS = ((100, "main app core base manager"), (80, "api client server handler controller"), (70, "model schema entity data"), (60, "service logic processor engine"), (40, "util helper common shared"))
LANGUAGES = {
    "python": "py", "javascript": "js jsx", "typescript": "ts tsx", "java": "java", "c": "c h", "cpp": "cpp hpp", "csharp": "cs", "go": "go", "rust": "rs", "php": "php", "ruby": "rb", "swift": "swift", "kotlin": "kt",
    "scala": "scala", "r": "r", "html": "html", "css": "css", "scss": "scss", "json": "json", "xml": "xml", "yaml": "yml yaml", "markdown": "md", "sql": "sql", "shell": "sh",
}
DETECTED = {
    "python": "py pyw pyx", "javascript": "js jsx mjs", "typescript": "ts tsx", "java": "java", "c": "c h", "cpp": "cpp cxx cc hpp", "csharp": "cs", "go": "go", "rust": "rs", "php": "php phtml", "ruby": "rb rbw",
    "swift": "swift", "kotlin": "kt kts", "scala": "scala sc",
}
CONTENT = {
    "python": ((r"^\s*def\s+\w+\s*\(.*\):", 0.8), (r"^\s*class\s+\w+.*:", 0.8), (r"^\s*import\s+\w+", 0.7), (r"^\s*from\s+\w+\s+import", 0.7), (r"^\s*if\s+__name__\s*==\s*[\"']__main__[\"']:", 0.9), (r"print\s*\(", 0.6), (r"^\s*#.*", 0.3)),
    "javascript": ((r"function\s+\w+\s*\(", 0.8), (r"const\s+\w+\s*=", 0.7), (r"let\s+\w+\s*=", 0.7), (r"var\s+\w+\s*=", 0.6), (r"require\s*\(", 0.8), (r"module\.exports", 0.8), (r"console\.log\s*\(", 0.7), (r"=>", 0.6)),
    "typescript": ((r"interface\s+\w+", 0.9), (r"type\s+\w+\s*=", 0.8), (r":\s*\w+(\[\])?(\s*\|\s*\w+)*\s*[=;]", 0.8), (r"function\s+\w+\s*\([^)]*:\s*\w+", 0.8), (r"import.*from\s+[\"']", 0.7), (r"export\s+(default\s+)?", 0.7)),
    "java": ((r"public\s+class\s+\w+", 0.9), (r"public\s+static\s+void\s+main", 0.9), (r"import\s+[\w.]+;", 0.8), (r"package\s+[\w.]+;", 0.8), (r"@\w+", 0.7), (r"System\.out\.println", 0.7)),
    "go": ((r"package\s+\w+", 0.9), (r"func\s+\w+\s*\(", 0.8), (r"import\s*\(", 0.8), (r"fmt\.Print", 0.8), (r"go\s+\w+\s*\(", 0.7), (r"defer\s+", 0.7)),
}
MENTIONS = {
    "python": ((r"__init__\.py", 0.9), (r"requirements\.txt", 0.8), (r"setup\.py", 0.8), ("pytest", 0.7), ("django|flask|fastapi", 0.6)),
    "javascript": ((r"package\.json", 0.9), ("node_modules", 0.8), ("npm|yarn", 0.7), ("react|vue|angular", 0.6)),
    "typescript": ((r"tsconfig\.json", 0.9), (r"\.d\.ts", 0.8), ("@types/", 0.7)),
    "java": ((r"pom\.xml", 0.9), (r"build\.gradle", 0.8), (r"\.jar", 0.7), ("maven|gradle", 0.6)),
}
ENTITY_PATTERNS = (
    ("flask_route", "endpoint", r"@app\.route\([\"']([^\"']+)[\"']", 1, 0.9),
    ("fastapi_endpoint", "endpoint", r"@app\.(get|post|put|delete|patch)\([\"']([^\"']+)[\"']", 1, 0.9),
    ("decorator", "decorator", r"@(\w+)", 1, 0.8),
    ("constants", "constant", r"^([A-Z][A-Z0-9_]*)\s*=", 1, 0.7),
    ("exception_class", "exception", r"class\s+(\w*(?:Error|Exception))\s*\(", 1, 0.9),
    ("test_function", "test", r"def\s+(test_\w+)\s*\(", 1, 0.9),
    ("model_class", "model", r"class\s+(\w+)(?:Model|Schema|Entity)\s*\(", 1, 0.8),
    ("utility_function", "utility", r"def\s+(_?\w*(?:util|helper|tool)\w*)\s*\(", 1, 0.7),
)


def _quoted(pattern: str) -> str:
    """A pattern in SQL, in which letters and digits are those of all scripts."""
    return pattern.replace(r"[\w$", r"[\pL\pN_$").replace(r"[\w.", r"[\pL\pN_.").replace(r"\w", r"[\pL\pN_]").replace("'", "''")


def _found(source: str, pattern: str, groups: int = 0) -> str:
    """Every match of the pattern in the rows (repo_id, file_path, content) of source: those columns, place (characters before it),
    matched, and a column for each group."""
    p = "(?m)" + _quoted(pattern)
    lists = "".join(f", regexp_extract_all(content, '{p}', {g}) as l{g}" for g in range(groups + 1))
    taken = "".join(f", l{g}[k] as g{g}" for g in range(1, groups + 1))
    return f"""(
    select repo_id, file_path, content, l0[k] as matched, len(array_to_string(pieces[1:k], '')) + len(array_to_string(l0[1:k - 1], '')) as place{taken}
    from (select *, unnest(generate_series(1, len(l0))) as k from (select repo_id, file_path, content, string_split_regex(content, '{p}') as pieces{lists} from {source} where regexp_matches(content, '{p}')))
)"""


_LINE_NO = "cast(1 + len(left(content, place)) - len(replace(left(content, place), chr(10), '')) as integer)"
_COLUMN = r"cast(1 + length(regexp_extract(left(content, place), '[^\n]*$')) as integer)"

_REFERENCES = r"""
with parent as (
    select regexp_replace(lower(uuid), '^\s*\{?\s*|\s*\}?\s*$', '', 'g') as key, min(created_at) as first_at
    from nodes where uuid is not null group by 1
), reference as (
    select uuid, 'from' as endpoint, regexp_replace(lower(from_uuid), '^\s*\{?\s*|\s*\}?\s*$', '', 'g') as key, created_at as seen
    from edges where from_uuid is not null
    union
    select uuid, 'to', regexp_replace(lower(to_uuid), '^\s*\{?\s*|\s*\}?\s*$', '', 'g'), created_at from edges where to_uuid is not null
), orphan as (
    select r.*, p.first_at from reference r left join parent p on p.key = r.key where coalesce(p.first_at > r.seen, true)
)
"""
SQL["p5_found"] = _REFERENCES + "select distinct uuid, endpoint from orphan"
SQL["p5_counts"] = _REFERENCES + """
select endpoint, strftime(seen, '%Y-%m') as month, count(*) as orphans,
       count(*) filter (where first_at is null) as waiting, count(*) filter (where first_at is not null) as resolved
from orphan group by 1, 2
"""
_DELETED = r"""
with gone as (
    select regexp_replace(lower(entity_uuid), '^\s*\{?\s*|\s*\}?\s*$', '', 'g') as key, "timestamp" as gone_at from audit
    where entity_type = 'node' and entity_uuid is not null and "timestamp" is not null and lower(trim(action)) = 'delete_entity'
), came as (select regexp_replace(lower(uuid), '^\s*\{?\s*|\s*\}?\s*$', '', 'g') as key, created_at as came_at from nodes where uuid is not null and created_at is not null),
reference as (
    select uuid, 'from' as endpoint, regexp_replace(lower(from_uuid), '^\s*\{?\s*|\s*\}?\s*$', '', 'g') as key, created_at as seen from edges where from_uuid is not null
    union
    select uuid, 'to', regexp_replace(lower(to_uuid), '^\s*\{?\s*|\s*\}?\s*$', '', 'g'), created_at from edges where to_uuid is not null
), as_of(t) as (values (timestamp '2025-07-01'), (timestamp '2025-10-01'), (timestamp '2026-01-01'), (timestamp '2026-04-01')),
dead as (select t, key, max(gone_at) as gone_at from gone, as_of where gone_at < t group by 1, 2),
parent as (select a.t, c.key, min(c.came_at) as first_at from came c join as_of a on c.came_at < a.t left join dead d on d.t = a.t and d.key = c.key where d.gone_at is null or c.came_at > d.gone_at group by 1, 2),
orphan as (select a.t, r.*, p.first_at from reference r join as_of a on r.seen < a.t left join parent p on p.t = a.t and p.key = r.key where coalesce(p.first_at > r.seen, true))
"""
SQL["p5_snapshots"] = _DELETED + """
select t as as_of, endpoint, strftime(seen, '%Y-%m') as month, count(*) as orphans, count(*) filter (where first_at is null) as waiting, count(*) filter (where first_at is not null) as resolved
from orphan group by 1, 2, 3
"""
SQL["p6_found"] = """
with change as (
    select distinct lower(trim(entity_uuid)) as key, timestamp as seq, lower(trim(action)) as action, details
    from audit
    where entity_type = 'node' and timestamp is not null and entity_uuid is not null
      and (details is null or (json_valid(details) and json_type(details) = 'OBJECT'))
), removed as (
    select key, max(seq) as seq from change where action = 'delete_entity' group by key
), live as (
    select c.* from change c left join removed r using (key)
    where (r.seq is null or c.seq >= r.seq) and c.action in ('add_node', 'create_entity', 'update_entity', 'tag_entity')
), made as (
    select key, min(seq) as seq from live where action in ('add_node', 'create_entity') group by key
), kept as (
    select l.*, list_contains(json_keys(l.details), 'name') as has_name, list_contains(json_keys(l.details), 'file_path') as has_path
    from live l join made m using (key) where l.seq >= m.seq
), named as (
    select key, details ->> '$.name' as name from kept where has_name qualify row_number() over (partition by key order by seq desc) = 1
), placed as (
    select key, details ->> '$.file_path' as file_path from kept where has_path qualify row_number() over (partition by key order by seq desc) = 1
)
select m.key as entity_uuid, n.name, p.file_path from made m left join named n using (key) left join placed p using (key)
"""


# ------------------------------------------------------------------------------------------------ the graph's tables

_ID = r"regexp_replace(lower({0}), '^\s*\{{?\s*|\s*\}}?\s*$', '', 'g')"
GRAPH = rf"""
with recursive entity as (
    select uuid, repo_id, file_path, type, name, start_line, end_line, docstring, tags, created_at from (
        select {_ID.format('uuid')} as uuid, repo_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') as file_path,
               lower(trim(type)) as type, trim(name) as name, start_line, end_line, docstring, tags, created_at,
               row_number() over (partition by {_ID.format('uuid')} order by created_at desc) as r
        from nodes where uuid is not null
    ) where r = 1
), link as (
    select src, dst, type, uuid from (
        select {_ID.format('from_uuid')} as src, {_ID.format('to_uuid')} as dst, lower(trim(type)) as type, uuid,
               row_number() over (partition by {_ID.format('from_uuid')}, {_ID.format('to_uuid')} order by created_at desc, uuid desc) as r
        from edges where from_uuid is not null and to_uuid is not null
    ) where r = 1
), link_end as (
    select src as uuid, 1 as o, 0 as i from link union all select dst, 0, 1 from link
), side as (
    select uuid, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from link_end group by uuid
), degree as (
    select e.*, coalesce(n_out, 0) as n_out, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) + coalesce(n_in, 0) as degree
    from entity e left join side s using (uuid)
), hub as (
    select uuid from degree order by n_in desc, uuid limit 1
), import_side as (
    select uuid, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (
        select src as uuid, 1 as o, 0 as i from link where type = 'imports' union all select dst, 0, 1 from link where type = 'imports'
    ) group by uuid
)
"""
# Without a second dot, and not for names that only begin with one.
ENDING = r"lower(regexp_extract(split_part(file_path, '/', -1), '[^.](\.[^.]*)$', 1))"
_LANGUAGE = (
    "case " + ENDING + " "
    + " ".join(f"when '.{e}' then '{k}'" for k, v in LANGUAGES.items() for e in v.split())
    + " else 'other' end"
)


def graph(name: str, sql: str) -> None:
    SQL[name] = GRAPH + sql


graph("node_type_distribution", "select coalesce(type, 'unknown') as type, count(*) as n from entity group by 1")
graph("edge_type_distribution", "select coalesce(type, 'unknown') as type, count(*) as n from link group by 1")
graph("extension_distribution", f"select repo_id, {ENDING} as ending, count(*) as n from entity where {ENDING} <> '' group by 1, 2")
graph("repository_sizes", """
, m as (select repo_id, count(*) as n_edges from link join entity e on e.uuid = src group by repo_id)
select repo_id, count(*) as n_nodes, coalesce(max(n_edges), 0) as n_edges,
       case when count(*) > 1 then coalesce(max(n_edges), 0) / (cast(count(*) as double) * (count(*) - 1)) else 0.0 end as density,
       cast(sum(degree) as double) / count(*) as average_degree, max(degree) as max_degree
from degree left join m using (repo_id) group by repo_id
""")
graph("degree_top10", "select uuid, name, type, degree, n_in, n_out from degree order by degree desc, uuid limit 10")
graph("complexity_top20", """
select repo_id, uuid, name, file_path, degree as score, n_in as incoming, n_out as outgoing
from degree where type = 'function' order by degree desc, uuid limit 20
""")
graph("complexity_histogram", """
select repo_id, count(*) filter (where degree <= 2) as low, count(*) filter (where degree > 2 and degree <= 5) as medium,
       count(*) filter (where degree > 5) as high, avg(degree) as average
from degree where type = 'function' group by repo_id
""")
graph("high_dependency_functions", """
select * from (
    select repo_id, uuid, name, file_path, degree as score, n_in as incoming, n_out as outgoing
    from degree where type = 'function' order by degree desc, uuid limit 20
) where incoming > 5 order by score desc, uuid limit 10
""")
_MEMBER = """
, member as (
    select f.repo_id, f.file_path, f.uuid, c.uuid as class_uuid, c.name as class_name
    from entity f join entity c on c.type = 'class' and f.type in ('function', 'method') and c.repo_id = f.repo_id and c.file_path = f.file_path
         and c.start_line < f.start_line and f.start_line <= c.end_line
    qualify row_number() over (partition by f.uuid order by c.end_line - c.start_line, c.uuid) = 1
)
"""
graph("class_members", _MEMBER + "select uuid, class_uuid from member")
graph("god_classes", _MEMBER + "select repo_id, file_path, class_uuid, class_name, count(*) as functions from member group by all having count(*) > 3")
_ISSUE = """
, issue as (
    select uuid, 'high_fan_out' as issue, n_out as n, case when n_out > 20 then 'high' else 'medium' end as severity from import_side where n_out > 10
    union all
    select uuid, 'high_fan_in', n_in, case when n_in > 25 then 'high' else 'medium' end from import_side where n_in > 15
)
"""
graph("fan_in_out_issues", _ISSUE + "select i.*, coalesce(e.name, '') as name from issue i left join entity e using (uuid)")
_CIRCUIT = """
, pair as (select distinct src, dst from link where {0}),
stroll(path, tail) as (
    select [src, dst], dst from pair where src < dst
    union all select list_append(path, dst), dst from stroll join pair on src = tail where len(path) < {1} and dst > path[1] and not list_contains(path, dst)
), circuit as (
    select array_to_string(path, '>') as path, len(path) as length from stroll join pair on src = tail and dst = path[1]
    union all select src, 1 from pair where src = dst
)
"""
graph("dependency_summary", _ISSUE + _CIRCUIT.format("type = 'imports'", 1000) + """
select (select count(*) from import_side) as nodes, (select count(*) from link where type = 'imports') as edges, (select count(*) from issue) as issues,
       (select count(*) from circuit) as cycles
""")
for _name, _column in (("most_depended", "n_in"), ("most_dependent", "n_out")):
    graph(_name, f"""
select t.uuid, coalesce(e.name, '') as name, n from (
    select uuid, {_column} as n from import_side where {_column} > 0 order by {_column} desc, uuid limit 10
) t left join entity e using (uuid)
""")
_LANG = f"""
, per as (select repo_id, {_LANGUAGE} as language, count(*) as n from entity where file_path <> '' and {ENDING} <> '' group by 1, 2),
whole as (select repo_id, count(*) as n_all, count(distinct file_path) as files from entity where file_path <> '' group by 1),
share as (select repo_id, language, n, n / n_all * 100 as percentage, files from per join whole using (repo_id))
"""
graph("language_distribution", _LANG + "select repo_id, language, n, percentage from share")
graph("language_summary", _LANG + """
select repo_id, max_by(language, {'a': n, 'b': percentage, 'c': language}) as primary_language, max_by(percentage, {'a': n, 'b': percentage, 'c': language}) as dominance,
       count(*) as diversity, count(*) filter (where percentage > 10) > 1 as multilingual, max(files) as files,
       array_to_string(list_transform(list_reverse_sort(list({'a': n, 'b': language}))[1:5], lambda x: x.b || ':' || x.a), ',') as main_languages
from share group by repo_id
""")
_QUALITY = """
, quality as (
    select repo_id, count(*) as n, avg(degree) as average_degree, count(*) filter (where degree <= 3) as low,
           count(*) filter (where degree > 3 and degree <= 7) as medium, count(*) filter (where degree > 7) as high,
           count(*) filter (where trim(docstring) <> '') as documented, count(*) filter (where type = 'function') as functions,
           count(distinct nullif(file_path, '')) as files,
           count(*) filter (where trim(docstring) <> '') / count(*) as documented_ratio,
           case when count(distinct nullif(file_path, '')) > 0 then count(*) filter (where type = 'function') / count(distinct nullif(file_path, '')) else 0.0 end as functions_per_file
    from degree group by repo_id
), score as (
    select repo_id, least(100.0, greatest(0.0, 100 - 10 * average_degree)) as maintainability,
           least(100.0, greatest(0.0, 100 - 100 * high / n)) as complexity, 100 * documented_ratio as documentation,
           least(100.0, greatest(0.0, 100 - 5 * abs(functions_per_file - 10))) as structure from quality
), overall as (
    select *, 0.3::double * maintainability + 0.3::double * complexity + 0.2::double * documentation + 0.2::double * structure as o,
           0.4::double * maintainability + 0.4::double * complexity + 0.2::double * documentation as c from score
)
"""
_GRADE = "case when {0} >= 90 then 'A' when {0} >= 80 then 'B' when {0} >= 70 then 'C' when {0} >= 60 then 'D' else 'F' end as grade"
graph("quality_metrics", _QUALITY + "select * from quality")
graph("quality_scores", _QUALITY + f"select repo_id, maintainability, complexity, documentation, structure, o as overall, {_GRADE.format('o')} from overall")
graph("quality_scores_compact", _QUALITY + f"select repo_id, maintainability, complexity, documentation, c as overall, {_GRADE.format('c')} from overall")
graph("quality_rounded", _QUALITY + f"select repo_id, round_even(maintainability, 2) as maintainability, round_even(complexity, 2) as complexity, round_even(documentation, 2) as documentation, round_even(structure, 2) as structure, round_even(o, 2) as overall, {_GRADE.format('o')} from overall")
graph("quality_recommendations", _QUALITY + """
select repo_id, 'reduce coupling between entities' as recommendation from score where maintainability < 70
union all select repo_id, 'split entities with many links' from score where complexity < 70
union all select repo_id, 'document more entities' from score where documentation < 50
union all select repo_id, 'balance the number of functions per file' from score where structure < 70
""")
_REACHED = """
, typed as (select src, dst from link where type in ('imports', 'calls', 'uses')),
one as (select distinct src as uuid from typed where dst in (select uuid from hub)),
two as (select distinct src as uuid from typed where dst in (select uuid from one))
"""
graph("impact_summary", _REACHED + """
, hit as (select uuid from one union select uuid from two)
select (select uuid from hub) as target, (select count(*) from one) as direct, (select count(*) from two) as transitive, (select count(*) from hit) as affected,
       (select count(distinct coalesce(file_path, 'unknown')) from hit left join entity using (uuid)) as files,
       (select count(*) from one) * 3 + (select count(*) from two) as score,
       case when (select count(*) from one) * 3 + (select count(*) from two) > 20 then 'high' when (select count(*) from one) * 3 + (select count(*) from two) > 10 then 'medium' else 'low' end as risk
""")
graph("affected_files", _REACHED + """
, hit as (select uuid from one union select uuid from two)
select (select uuid from hub) as target, coalesce(file_path, 'unknown') as file_path, count(*) as entities from hit left join entity using (uuid) group by 1, 2 order by 2 limit 20
""")

graph("affected_entities", _REACHED + """
, hit as (select uuid from one union select uuid from two)
select (select uuid from hub) as target, coalesce(file_path, 'unknown') as file_path, uuid, coalesce(name, '') as name, coalesce(type, '') as type from hit left join entity using (uuid)
""")

# ------------------------------------------------------------------------------------------------ search and pages

graph("search_filters", "select uuid, name, type, file_path from entity where type = 'function' and contains(file_path, 'core/') and list_has_any(tags, ['ASYNC', 'UTILITY'])")
_RELEVANCE = """
case type when 'function' then 1.0 when 'async_function' then 1.0 when 'class' then 0.9 when 'import' then 0.3 else 0.5 end::double
+ case when length(docstring) > 0 then 0.2 else 0.0 end::double + case when list_has_any(tags, ['API', 'SERVICE', 'DATABASE', 'UTILITY']) then 0.3 else 0.0 end::double
+ greatest(0.0::double, (5 - (length(file_path) - length(replace(file_path, '/', '')))) * 0.1::double)
"""
graph("search_relevance", f"select uuid, name, round({_RELEVANCE}, 6) as relevance from entity where type = 'class' order by {_RELEVANCE} desc, uuid limit 50 offset 10")
graph("search_exact_name", """
select uuid, name, case when lower(name) = 'load' then 1.0 when starts_with(lower(name), 'load') then 0.9 else 0.7 end::double as score
from entity where contains(lower(name), 'load')
""")
graph("autocomplete", "select uuid, name, type from entity where starts_with(lower(name), 'par') order by uuid limit 20")
graph("entity_index", "select uuid, name, type, file_path, start_line, left(docstring, 100) as short_doc from entity")
graph("entities_page", "select uuid, name, type, file_path, (select count(*) from entity where type = 'method') as total from entity where type = 'method' order by uuid limit 50 offset 100")
graph("entity_by_id", "select uuid, name, type, file_path from entity where uuid in (select uuid from hub)")
graph("relations_page", "select src, dst, type, (select count(*) from link where type = 'calls') as total from link where type = 'calls' order by src, dst limit 50 offset 20")
SQL["repositories"] = "select distinct repo_id from nodes"
_TAGS = " , ".join(f"case when regexp_matches(lower(name), '{w.replace(' ', '|')}') then '{t}' end" for t, w in TAG_WORDS.items())
graph("auto_tags", f"""
select uuid, array_to_string(list_filter([upper(type), {_TAGS},
    case when type = 'function' and starts_with(name, 'test_') then 'TEST' when type = 'function' and starts_with(name, '_') then 'PRIVATE'
         when type = 'class' and regexp_matches(name, '(Error|Exception)$') then 'EXCEPTION' when type = 'class' and ends_with(name, 'Test') then 'TEST' end], lambda x: x is not null), ',') as tags
from entity
""")
_FILE = "with file as (select repo_id, file_path, any_value(content) as content, any_value(n_bytes) as n_bytes from source_files group by 1, 2)\n"
_BASE = "lower(split_part(file_path, '/', -1))"
_LEVELS = "(length(file_path) - length(replace(file_path, '/', '')))"
SQL["file_priority"] = _FILE + "select repo_id, file_path, " + " + ".join(f"case when regexp_matches({_BASE}, '{w.replace(' ', '|')}') then {p} else 0 end" for p, w in PRIORITY_WORDS) + f"""
 + case when {_LEVELS} <= 2 then 30 when {_LEVELS} > 5 then -20 else 0 end + least(20, n_bytes // 1000) as priority from file
"""
SQL["file_priority_cut"] = f"""
with ranked as (select *, row_number() over (partition by repo_id order by priority desc, file_path) as r, count(*) over (partition by repo_id) as n from ({SQL['file_priority']}))
select repo_id, file_path, priority from ranked where n <= 5 or r <= greatest(3, cast(floor(n * 0.8::double) as bigint))
"""
SQL["relative_paths"] = _FILE + r"select repo_id, file_path, replace(file_path, '\', '/') as relative from file"
SQL["module_names"] = _FILE + "select repo_id, file_path, replace(replace(file_path, '.py', ''), '/', '.') as module from file"
SQL["analysed_files"] = _FILE + rf"""
select repo_id, file_path from file
where regexp_matches({_BASE}, '\.(py|js|jsx|ts|tsx)$') and not regexp_matches({_BASE}, 'test_|tests_|_test\.py|_tests\.py|conftest\.py|setup\.py|__init__\.py')
  and not regexp_matches('/' || file_path, '/(\.[^/]*|__pycache__|venv|env|node_modules|dist|build|htmlcov|docs|documentation|examples)/')
"""
SQL["repository_size_class"] = _FILE + """
select repo_id, count(*) as files, case when count(*) <= 20 then 'small' when count(*) <= 50 then 'medium' when count(*) <= 150 then 'large' else 'huge' end as size from file group by repo_id
"""
graph("link_weights", """
select dst, round(sum(case type when 'calls' then 1.0 when 'imports' then 0.8 when 'inherits' then 1.2 when 'defines' then 0.6 when 'uses' then 0.4 else 1.0 end::double), 6) as weight from link group by dst
""")
SQL["ranking_edges"] = f"""
select {_ID.format('from_uuid')} as src, {_ID.format('to_uuid')} as dst,
       case lower(trim(type)) when 'calls' then 1.0 when 'imports' then 0.8 when 'inherits' then 1.2 when 'defines' then 0.6 when 'uses' then 0.4 else 1.0 end::double as weight
from edges where from_uuid is not null and to_uuid is not null
"""
graph("importance_rank", f"""
, called as (select repo_id, name, count(*) as calls from link join entity e on e.uuid = link.dst where link.type = 'calls' group by 1, 2),
raw as (
    select e.uuid, e.repo_id, 0.1::double + 0.2::double * coalesce(calls, 0)
        + case type when 'function' then 0.3 when 'class' then 0.4 when 'module' then 0.2 else 0.1 end::double
        + case when regexp_matches({_BASE}, 'main|app|core|manager') then 0.3 when regexp_matches({_BASE}, 'api|server|client') then 0.2 when regexp_matches({_BASE}, 'util|helper|common') then 0.1 else 0.0 end::double
        + case when regexp_matches(lower(e.name), 'main|init|setup|start|run') then 0.2 when starts_with(e.name, '_') and not starts_with(e.name, '__') then -0.1 when starts_with(e.name, 'test_') then -0.2 else 0.0 end::double
        + least(0.1::double * n_in, 0.5::double) as raw
    from degree e left join called c on c.repo_id = e.repo_id and c.name = e.name
)
select uuid, round(raw / max(raw) over (partition by repo_id), 6) as importance from raw
""")

# ------------------------------------------------------------------------------------------------ traversal

graph("neighbors_both", """
select uuid, name, type, file_path from entity where uuid in (
    select dst from link where src in (select uuid from hub) union select src from link where dst in (select uuid from hub))
""")
graph("edges_for_node", "select src, dst, type from link where src in (select uuid from hub) union all select src, dst, type from link where dst in (select uuid from hub)")
_BFS = """
, walk(uuid, depth) as (
    select uuid, 0 from hub union select l.dst, depth + 1 from walk join link l on l.src = walk.uuid where depth < 3
), near as (select uuid, min(depth) as depth from walk group by uuid)
"""
graph("subgraph_bfs", _BFS + "select uuid, depth from near")
graph("subgraph_links", _BFS + "select src, dst, type from link where src in (select uuid from near) and dst in (select uuid from near)")
for _name, _a, _b, _d in (("call_tree", "src", "dst", 4), ("caller_tree", "dst", "src", 3)):
    graph(_name, f"""
, step as (
    select {_a} as uuid, {_b} as child from link where type in ('calls', 'inherits', 'uses') qualify row_number() over (partition by {_a} order by {_b}) <= 5
), tree(path, depth, uuid, parent) as (
    select [uuid], 0, uuid, cast(null as varchar) from hub
    union all
    select list_append(path, child), depth + 1, child, tree.uuid from tree join step on step.uuid = tree.uuid where depth < {_d} and not list_contains(path, child)
)
select array_to_string(path, '>') as path, depth, uuid, parent from tree
""")
for _name, _a, _b, _kinds in (
    ("dependencies_by_type", "src", "dst", ("imports", "calls", "uses", "inherits")),
    ("dependents_by_type", "dst", "src", ("imported_by", "called_by", "used_by", "inherited_by")),
):
    _case = " ".join(f"when '{k}' then '{v}'" for k, v in zip(("imports", "calls", "uses", "inherits"), _kinds))
    graph(_name, f"""
select l.{_a} as id, case l.type {_case} end as kind, e.uuid, e.name from link l join entity e on e.uuid = l.{_b}
where l.type in ('imports', 'calls', 'uses', 'inherits') and l.{_a} in (select uuid from entity where type = 'class')
""")
_TEXT = r"""
, file as (
    select repo_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') as file_path, string_split(replace(any_value(content), chr(13) || chr(10), chr(10)), chr(10)) as rows
    from source_files where content is not null group by 1, 2
), placed as (
    select e.*, f.rows from entity e join file f on f.repo_id = e.repo_id and f.file_path = e.file_path
    where e.start_line is not null and e.end_line is not null and e.start_line <= len(f.rows)
)
"""
graph("code_snippets", _TEXT + """
, cut as (
    select uuid, array_to_string(rows[greatest(start_line - 3, 1):start_line - 1], chr(10)) as before, array_to_string(rows[start_line:end_line], chr(10)) as code,
           array_to_string(rows[end_line + 1:end_line + 3], chr(10)) as after, rows[start_line:end_line] as inner_rows from placed
)
select uuid, before, code, after, array_to_string(list_filter(list_transform(inner_rows, lambda x: trim(x)), lambda x: starts_with(x, 'import ') or starts_with(x, 'from ')), chr(10)) as imports from cut
""")
graph("entity_context", _TEXT + """
, pair as (select src as uuid, dst as other from link union all select dst, src from link),
near as (
    select uuid, string_agg(other, ',' order by other) as neighbours from (
        select uuid, other from (select distinct uuid, other from pair where other in (select uuid from entity)) qualify row_number() over (partition by uuid order by other) <= 10
    ) group by uuid
), kinds as (
    select uuid, kind, count(*) as n from (select src as uuid, coalesce(type, 'unknown') || '>' as kind from link union all select dst, '<' || coalesce(type, 'unknown') from link) group by 1, 2
), amount as (select uuid, cast(sum(n) as bigint) as n_links, string_agg(kind || ':' || n, ',' order by kind || ':' || n) as links from kinds group by uuid)
select e.uuid, e.name, array_to_string(p.rows[p.start_line:p.end_line], chr(10)) as code, coalesce(near.neighbours, '') as neighbours, coalesce(n_links, 0) as n_links, coalesce(links, '') as links
from entity e left join placed p on p.uuid = e.uuid left join near on near.uuid = e.uuid left join amount on amount.uuid = e.uuid where e.type = 'endpoint'
""")
graph("entity_at_line", _TEXT + """
, place as (select repo_id, file_path, unnest(generate_series(1, greatest(len(rows), 1))) as line from file)
select p.repo_id, p.file_path, p.line, e.uuid from place p join entity e on e.repo_id = p.repo_id and e.file_path = p.file_path and e.end_line >= e.start_line
     and p.line between e.start_line and e.end_line
qualify row_number() over (partition by p.repo_id, p.file_path, p.line order by e.end_line - e.start_line, e.uuid) = 1
""")

# ------------------------------------------------------------------------------------------------ graph algorithms


def _pagerank(rounds: int, tolerance: float) -> str:
    """As many rounds as it takes for the ranks to move less than the tolerance per entity; rounds has to be enough."""
    parts = [", pair as (select distinct l.src, l.dst from link l join entity a on a.uuid = l.src join entity b on b.uuid = l.dst), outs as (select src, count(*) as n_out from pair group by src), size as (select count(*) as n from entity), r0 as (select uuid, n_out, 1.0::double / n as rank, 1e9::double as old from entity left join outs on src = uuid, size)"]
    for k in range(1, rounds + 1):
        parts.append(f""", r{k} as materialized (
    select r.uuid, r.n_out, 0.15::double / n + 0.85::double * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from r{k - 1} where n_out is null) / n) as rank, r.rank as old
    from r{k - 1} r left join (select dst, sum(rank / n_out) as got from pair join r{k - 1} on uuid = src group by dst) g on g.dst = r.uuid, size)""")
    moved = " union all ".join(f"select {k} as k, sum(abs(rank - old)) as moved from r{k}" for k in range(1, rounds + 1))
    ranks = " union all ".join(f"select {k} as k, uuid, rank from r{k}" for k in range(1, rounds + 1))
    return GRAPH.replace("with recursive", "with") + "".join(parts) + f""", last as (select min(k) as k from ({moved}), size where moved < {tolerance}::double * n)
select uuid, round(rank * 1e6, 3) as rank_per_million from ({ranks}) join last using (k)"""


SQL["pagerank"] = _pagerank(30, 1e-6)
_FAR = """
, line_ as (select distinct src, dst from link),
member as (select uuid from entity union select src from line_ union select dst from line_),
far(source, uuid, depth, paths) using key (source, uuid) as (
    select uuid, uuid, 0, 1.0::double from member
    union all
    select w.source, l.dst, w.depth + 1, sum(w.paths) from far w join line_ l on l.src = w.uuid left join recurring.far k on k.source = w.source and k.uuid = l.dst
    where k.source is null group by w.source, l.dst, w.depth
)
"""
graph("shortest_paths", _FAR + "select source, uuid, depth, paths from far where depth > 0")
_CLOSE = """
, near as (select uuid, count(*) as r, sum(depth) as d from far where depth > 0 group by uuid), amount as (select count(*) as n from member),
close as (select m.uuid, coalesce((r / d) * (r / greatest(n - 1, 1)), 0) as closeness from member m left join near using (uuid), amount)
"""
graph("closeness", _FAR + _CLOSE + "select uuid, round(closeness * 1e6, 3) as closeness_millionths from close")
_BETWEEN = """
, through as (
    select a.uuid, sum(a.paths * b.paths / c.paths) as s from far a join far b on b.source = a.uuid join far c on c.source = a.source and c.uuid = b.uuid
    where a.depth > 0 and b.depth > 0 and a.source <> b.uuid and c.depth = a.depth + b.depth group by a.uuid
), size_ as (select count(*) as n from member),
between_ as (select m.uuid, coalesce(s, 0) * (1.0::double / ((n - 1) * (n - 2))) as betweenness from member m left join through using (uuid), size_)
"""
graph("betweenness", _FAR + _BETWEEN + "select uuid, round(betweenness * 1e6, 3) as betweenness_millionths from between_")


def _hotspots(rounds: int) -> str:
    """Ranks over all members, as they stand in the first round that moves them less than a millionth each."""
    parts = [", outs as (select src, count(*) as n_out from line_ group by src), r0 as (select uuid, n_out, 1.0::double / n as rank, 1e9::double as old from member left join outs on src = uuid, size_)"]
    for k in range(1, rounds + 1):
        parts.append(f""", r{k} as materialized (
    select r.uuid, r.n_out, 0.15::double / n + 0.85::double * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from r{k - 1} where n_out is null) / n) as rank, r.rank as old
    from r{k - 1} r left join (select dst, sum(rank / n_out) as got from line_ join r{k - 1} on uuid = src group by dst) g on g.dst = r.uuid, size_)""")
    moved = " union all ".join(f"select {k} as k, sum(abs(rank - old)) as moved from r{k}" for k in range(1, rounds + 1))
    ranks = " union all ".join(f"select {k} as k, uuid, rank from r{k}" for k in range(1, rounds + 1))
    return GRAPH + _FAR + _CLOSE + _BETWEEN + "".join(parts) + f"""
, last_ as (select min(k) as k from ({moved}), size_ where moved < 1e-6::double * n), ranked as (select uuid, rank from ({ranks}) join last_ using (k)),
scored as (select uuid, betweenness, closeness, rank, 0.4::double * betweenness + 0.3::double * closeness + 0.3::double * rank as score from between_ join close using (uuid) join ranked using (uuid)),
ends_ as (select uuid, count(*) as connections from (select src as uuid from line_ union all select dst from line_) group by uuid)
select s.uuid, name, type, file_path, coalesce(connections, 0) as connections, round(score * 1e6, 3) as score_millionths, round(betweenness * 1e6, 3) as betweenness_millionths,
       round(closeness * 1e6, 3) as closeness_millionths, round(rank * 1e6, 3) as rank_millionths, round((select avg(score) from scored) * 1e6, 3) as average_millionths
from (select * from scored order by score desc, uuid limit 10) s left join entity using (uuid) left join ends_ using (uuid)
"""


SQL["hotspots"] = _hotspots(30)
graph("strong_components", _FAR + """
, component as (select a.source as uuid, min(a.uuid) as c from far a join far b on b.source = a.uuid and b.uuid = a.source group by 1)
select size, count(*) as components from (select c, count(*) as size from component group by c) group by size
""")
graph("repository_components", """
, line_ as (select distinct l.src, l.dst, a.repo_id from link l join entity a on a.uuid = l.src join entity b on b.uuid = l.dst where a.repo_id = b.repo_id),
far(source, uuid) using key (source, uuid) as (
    select uuid, uuid from entity
    union all
    select distinct w.source, l.dst from far w join line_ l on l.src = w.uuid left join recurring.far k on k.source = w.source and k.uuid = l.dst where k.source is null
), component as (select a.source as uuid, min(a.uuid) as c from far a join far b on b.source = a.uuid and b.uuid = a.source group by 1)
select repo_id, count(distinct c) as components from component join entity using (uuid) group by repo_id
""")
for _name, _where, _most in (("import_cycles", "type in ('imports', 'depends_on')", 1000), ("dependency_cycles", "type in ('imports', 'depends_on', 'uses')", 1000), ("link_cycles", "true", 4)):
    graph(_name, _CIRCUIT.format(_where, _most) + "select path, cast(length as integer) as length, case when length <= 3 then 'high' else 'medium' end as severity from circuit")

# ------------------------------------------------------------------------------------------------ text

_LINE = _FILE + """, line as (
    select repo_id, file_path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as n from file where content is not null
)
"""
_JS = r"regexp_matches(lower(file_path), '\.(js|jsx|mjs|ts|tsx)$')"
for _name, _id, _severity, _pattern, _where in (
    ("rule_long_lines", "long_lines", "info", r".{121,}", "true"),
    ("rule_bare_except", "python_bare_except", "warning", r"except\s*:", r"regexp_matches(lower(file_path), '\.(py|pyw|pyx)$')"),
    ("rule_var", "js_var_usage", "warning", r"\bvar\s+\w+", _JS),
    ("rule_todo", "todo_comments", "info", r"(?:#|//|/\*)\s*TODO\s*:?\s*(.+)", "true"),
    ("rule_secrets", "hardcoded_secret", "error", r"""(?:password|secret|key|token)\s*[=:]\s*['"][^'"]{8,}['"]""", "true"),
    ("rule_semicolons", "js_missing_semicolon", "info", r"[^;\s]\s*\n\s*[^\/\*\s]", _JS),
    ("rule_complex", "complex_function", "warning", r"def\s+\w+\([^)]*\):[^}]{200,}", "true"),
):
    _source = "(select repo_id, file_path, replace(content, ' (TypeError, ValueError)', '') as content from file)" if _name == "rule_bare_except" else "file"
    SQL[_name] = _FILE + f"""
select '{_id}' as rule_id, '{_severity}' as severity, repo_id, file_path, {_LINE_NO} as line, {_COLUMN} as "column", matched from {_found(_source, _pattern)} where {_where}
"""


def _detection() -> str:
    def quoted(p: str) -> str:
        return p.replace("'", "''")

    content = {k: " + ".join(f"least(len(regexp_extract_all(content, '(?im){quoted(p)}')), 5) * {w}::double" for p, w in v) for k, v in CONTENT.items()}
    mention = {k: " + ".join(f"case when regexp_matches(content, '(?i){quoted(p)}') then {w}::double else 0 end" for p, w in v) for k, v in MENTIONS.items()}

    def best(scores: dict[str, str], label: str) -> str:
        rows = " union all ".join(f"select repo_id, file_path, '{k}' as language, {-i} as place, round({s}, 6) as score from file" for i, (k, s) in enumerate(scores.items()))
        return f", {label} as (select * from ({rows}) where score > 0 qualify row_number() over (partition by repo_id, file_path order by score desc, place desc) = 1)"

    cases = " ".join(f"when '.{e}' then '{k}'" for k, v in DETECTED.items() for e in v.split())
    return (
        "with file as (select repo_id, file_path, coalesce(any_value(content), '') as content from source_files group by 1, 2)"
        + best(content, "by_content") + best(mention, "by_mention")
        + f"""
, vote as (
    select repo_id, file_path, case {ENDING} {cases} end as language, 0.9::double as w, 0 as way, 'extension' as said from file
    union all select repo_id, file_path, language, least(score / 10, 1) * 1.2::double, 1, 'content' from by_content
    union all select repo_id, file_path, language, least(score / 5, 1) * 0.8::double, 2, 'heuristic' from by_mention
), cast_ as (select * from vote where language is not null),
summed as (select repo_id, file_path, language, round(sum(w), 6) as score, min(way) as way from cast_ group by 1, 2, 3),
amount as (select repo_id, file_path, count(*) as n, string_agg(said, '+' order by way) as method from cast_ group by 1, 2),
top as (select * from summed qualify row_number() over (partition by repo_id, file_path order by score desc, way) = 1)
select f.repo_id, f.file_path, coalesce(t.language, 'unknown') as language, round(case when t.score is null then 0.0 else least(t.score / a.n, 1.0) end::double, 6) as confidence, coalesce(a.method, 'none') as method
from file f left join top t using (repo_id, file_path) left join amount a using (repo_id, file_path)
"""
    )


SQL["language_detection"] = _detection()


def _figures(counts: dict[str, str], flags: dict[str, tuple[str, ...]], names: dict[str, str], frameworks: dict[str, str], endings: str) -> str:
    q = lambda p: p.replace("'", "''")
    has = lambda p: f"regexp_matches(content, '{q(p)}')"
    columns = [f"cast(len(regexp_extract_all(content, '{q(p)}')) as integer) as {n}" for n, p in counts.items()]
    columns += [f"({' and '.join(map(has, p))}) as {n}" for n, p in flags.items()]
    columns += [f"array_to_string(regexp_extract_all(content, '{q(p)}', 1), ',') as {n}" for n, p in names.items()]
    known = ", ".join("case when " + " or ".join(f"contains(content, '{w}')" for w in words.split()) + f" then '{n}' end" for n, words in frameworks.items())
    return _FILE + f"""
select repo_id, file_path, {', '.join(columns)}, array_to_string(list_filter([{known}], lambda x: x is not null), ',') as frameworks
from file where content is not null and regexp_matches(lower(file_path), '\\.({endings})$')
"""


SQL["python_figures"] = _figures(
    {
        "imports": r"import\s+(\w+(?:\.\w+)*)", "from_imports": r"from\s+(\w+(?:\.\w+)*)\s+import\s+(.+)", "aliased_imports": r"import\s+(\w+(?:\.\w+)*)\s+as\s+(\w+)", "decorators": r"@(\w+(?:\.\w+)*)",
        "async_functions": r"async\s+def\s+(\w+)", "awaits": r"await\s+(\w+)", "list_comprehensions": r"\[.+\s+for\s+.+\s+in\s+.+\]", "dict_comprehensions": r"\{.+:\s*.+\s+for\s+.+\s+in\s+.+\}",
        "set_comprehensions": r"\{.+\s+for\s+.+\s+in\s+.+\}", "context_managers": r"with\s+(\w+(?:\.\w+)*)", "double_quoted_docs": r'(?s)""".*?"""', "single_quoted_docs": r"(?s)'''.*?'''",
    },
    {"uses_asyncio": (r"asyncio\.",), "has_type_hints": (r":\s*\w+",), "has_return_annotations": (r"->\s*\w+",), "uses_typing": (r"from\s+typing\s+import",)},
    {"decorator_names": r"@(\w+(?:\.\w+)*)", "async_names": r"async\s+def\s+(\w+)", "await_names": r"await\s+(\w+)", "context_names": r"with\s+(\w+(?:\.\w+)*)"},
    {"Django": "django models.Model HttpResponse", "Flask": "flask @app.route request Response", "FastAPI": "fastapi @app.get @app.post Depends", "NumPy": "numpy np.array np.", "Pandas": "pandas pd.DataFrame pd."},
    "py|pyw|pyx",
)
SQL["javascript_figures"] = _figures(
    {
        "es6_imports": r"import\s+.+\s+from\s+['\"](.+)['\"]", "requires": r"require\s*\(\s*['\"](.+)['\"]\s*\)", "exports": r"export\s+(?:default\s+)?(.+)", "arrow_functions": r"=>\s*\{|=>\s*\w+", "classes": r"class\s+\w+",
        "array_destructuring": r"\[\s*\w+", "object_destructuring": r"\{\s*\w+", "template_literals": r"`[^`]*\$\{[^}]*\}[^`]*`",
    },
    {"uses_promises": ("Promise",), "uses_async_await": ("async", "await"), "uses_then_catch": (r"\.then\(|\.catch\(",)},
    {"import_names": r"import\s+.+\s+from\s+['\"](.+)['\"]", "require_names": r"require\s*\(\s*['\"](.+)['\"]\s*\)", "export_names": r"export\s+(?:default\s+)?(.+)"},
    {"React": "React useState useEffect jsx", "Vue": "Vue v-if v-for @click", "Angular": "@Component @Injectable ngOnInit", "Express": "express app.get app.post", "Node.js": "require module.exports process."},
    "js|jsx|mjs",
)
SQL["language_capabilities"] = """
select * from (values
    ('python', 'object-oriented, functional, procedural', 'dynamic', true, 'Django, Flask, FastAPI, NumPy', 'pip, conda, poetry', '.py, .pyw, .pyx', 'pytest, unittest, nose', true, true, 'full'),
    ('javascript', 'functional, object-oriented, event-driven', 'dynamic', false, 'React, Vue, Angular, Express, Node.js', 'npm, yarn, pnpm', '.js, .jsx, .mjs', 'Jest, Mocha, Jasmine', true, true, 'full'),
    ('typescript', 'object-oriented, functional', 'static', false, 'Angular, React, Vue, NestJS', 'npm, yarn, pnpm', '.ts, .tsx, .d.ts', 'Jest, Mocha, Vitest', false, false, 'basic'),
    ('java', 'object-oriented', 'static', false, 'Spring, Hibernate, Struts', 'Maven, Gradle', '.java', 'JUnit, TestNG', false, false, 'basic'),
    ('go', 'procedural, concurrent', 'static', false, 'Gin, Echo, Fiber', 'go mod', '.go', 'testing', false, false, 'basic')
) t(language, paradigms, typing, indentation_matters, frameworks, package_managers, endings, test_frameworks, has_analyzer, has_parser, depth)
union all select language, null, null, null, null, null, null, null, false, false, 'basic' from (select unnest(['c', 'cpp', 'csharp', 'rust', 'php', 'ruby', 'swift', 'kotlin', 'scala']) as language)
"""
SQL["idioms"] = _FILE + rf"""
select 'context_manager' as pattern, 0.9::double as confidence, repo_id, file_path from file where {ENDING} = '.py' and contains(content, 'with ')
union all select 'list_comprehension', 0.8, repo_id, file_path from file where {ENDING} = '.py' and regexp_matches(content, '\[.+for\s+.+in\s+.+\]')
union all select 'arrow_function', 0.8, repo_id, file_path from file where {ENDING} in ('.js', '.ts') and contains(content, '=>')
union all select 'destructuring', 0.8, repo_id, file_path from file where {ENDING} in ('.js', '.ts') and regexp_matches(content, '(?:const|let|var)\s*\{{\s*\w+.*\}}\s*=')
"""
SQL["magic_numbers"] = _LINE + r"select repo_id, file_path, cast(n as integer) as line, unnest(regexp_extract_all(text, '\b\d{2,}\b')) as number from line"
SQL["duplicate_blocks"] = _FILE + r"""
, whole as (select repo_id, file_path, content from file where content is not null union all select 'documents', cast(doc_id as varchar), text from documents where text is not null),
line as (select repo_id, file_path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as n from whole),
block as (
    select repo_id, file_path, n, text || chr(10) || lead(text, 1) over w || chr(10) || lead(text, 2) over w || chr(10) || lead(text, 3) over w || chr(10) || lead(text, 4) over w as block, count(*) over (partition by repo_id, file_path) as size
    from line window w as (partition by repo_id, file_path order by n)
), again as (
    select repo_id, file_path, min(n) as line from block where block is not null and size >= 10 and regexp_replace(block, '\s+', '', 'g') <> '' group by repo_id, file_path, block having max(n) - min(n) >= 5
)
select repo_id, file_path, cast(min(line) as integer) as line from again group by 1, 2
"""
_PY_LINE = """with file as (select repo_id, file_path, replace(any_value(content), chr(13) || chr(10), chr(10)) as content from source_files where ends_with(file_path, '.py') and content is not null group by 1, 2),
line as (select repo_id, file_path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as n from file)
"""
_PY = "with file as (select repo_id, file_path, replace(any_value(content), chr(13) || chr(10), chr(10)) as content from source_files where ends_with(file_path, '.py') and content is not null group by 1, 2)\n"


def _entities(name: str, kind: str, pattern: str, group: int, confidence: float) -> str:
    groups = 2 if name == "fastapi_endpoint" else 1
    path = "g2" if groups == 2 else "cast(null as varchar)"
    return f"select repo_id, file_path, {_LINE_NO} as line, '{name}' as pattern, '{kind}' as type, g{group} as name, {confidence}::double as confidence, {path} as metadata from {_found('file', pattern, groups)}"


_PATTERN_ENTITIES = " union all ".join(_entities(*p) for p in ENTITY_PATTERNS)
SQL["pattern_entities"] = _PY + _PATTERN_ENTITIES
SQL["variables_constants"] = _PY_LINE + r"""
, found as (
    select repo_id, file_path, n, regexp_extract(text, '^(\w+)\s*=\s*(.+)$', 1) as name, regexp_extract(text, '^(\w+)\s*=\s*(.+)$', 2) as value
    from line where regexp_matches(text, '^(\w+)\s*=\s*(.+)$') and not regexp_matches(text, '^\w+\s*=\s*=')
)
select repo_id, file_path, cast(n as integer) as line, name, case when upper(name) = name and regexp_matches(name, '[A-Z]') then 'constant' else 'variable' end as type, left(value, 50) as value
from found where not regexp_matches(value, 'import|def |class ')
"""
SQL["text_relations"] = _PY + " union all ".join(
    f"select repo_id, file_path, {_LINE_NO} as line, '{k}' as relation, g{a} as source, g{b} as target, {c}::double as confidence from {_found('file', p, 2)}"
    for k, p, a, b, c in (("inherits", r"class\s+(\w+)\s*\(\s*(\w+)", 1, 2, 0.9), ("imports", r"from\s+(\w+)\s+import\s+(\w+)", 2, 1, 0.9), ("composes", r"self\.(\w+)\s*=\s*(\w+)\(", 1, 2, 0.7))
)
graph("decorated_functions", _PY_LINE.replace("with file", ", file") + r"""
, mark as (select repo_id, file_path, n, regexp_extract(text, '^\s*@(\w+)', 1) as decorator from line where regexp_matches(text, '^\s*@\w+')),
head as (select repo_id, file_path, n, regexp_extract(text, 'def\s+(\w+)', 1) as function from line where regexp_matches(text, '^\s*(?:async\s+)?def\s+\w+')),
first as (
    select m.repo_id, m.file_path, m.decorator, h.function from mark m join head h on h.repo_id = m.repo_id and h.file_path = m.file_path and h.n between m.n + 1 and m.n + 4
    qualify row_number() over (partition by m.repo_id, m.file_path, m.n order by h.n) = 1
), known as (select repo_id, file_path, name, min(uuid) as uuid from entity where type in ('function', 'method') group by 1, 2, 3)
select f.repo_id, f.file_path, f.decorator, f.function, k.uuid, not exists (select 1 from entity e where e.repo_id = f.repo_id and e.file_path = f.file_path and e.name = f.decorator) as external
from first f join known k on k.repo_id = f.repo_id and k.file_path = f.file_path and k.name = f.function
""")
_TESTS = """
, tested as (select uuid, repo_id, file_path, type, name, start_line, end_line from entity union all select uuid || '-test', repo_id, file_path, type, 'test_' || name, start_line, end_line from entity where type = 'function')
"""
graph("test_subjects", _TESTS + r"""
, test as (select repo_id, uuid, regexp_extract(name, '^test_([^_]*)', 1) as name from tested where type in ('function', 'method') and starts_with(name, 'test_')),
subject as (select repo_id, name, min(uuid) as uuid from tested where type in ('function', 'method', 'class') group by 1, 2)
select t.uuid as test, s.uuid as subject, 0.7::double as confidence from test t join subject s on s.repo_id = t.repo_id and s.name = t.name where t.name <> '' and t.uuid <> s.uuid
""")
_HEADS = r""", head as (select repo_id, file_path, n, regexp_extract(text, 'def\s+(\w+)', 1) as function from line where regexp_matches(text, '^\s*(?:async\s+)?def\s+\w+')),
known as (select repo_id, file_path, name, min(uuid) as uuid from entity where type in ('function', 'method') group by 1, 2, 3)
"""
_ROUTES = " union all ".join(
    f"select repo_id, file_path, {_LINE_NO} as n, g{g} as endpoint from {_found('file', p, g)}" for p, g in ((ENTITY_PATTERNS[0][2], 1), (ENTITY_PATTERNS[1][2], 2))
)
graph("endpoint_handlers", _PY_LINE.replace("with file", ", file") + _HEADS + f"""
, mark as ({_ROUTES})
select m.repo_id, m.file_path, m.endpoint, k.uuid, 0.9::double as confidence
from mark m join head h on h.repo_id = m.repo_id and h.file_path = m.file_path and h.n between m.n - 2 and m.n + 4
     join known k on k.repo_id = h.repo_id and k.file_path = h.file_path and k.name = h.function
qualify row_number() over (partition by m.repo_id, m.file_path, m.n, m.endpoint order by h.n, k.uuid) = 1
""")
graph("tests_by_calls", _TEXT + _TESTS + r"""
, run as (select e.uuid, e.repo_id, array_to_string(f.rows[e.start_line:e.end_line], chr(10)) as code from tested e join file f on f.repo_id = e.repo_id and f.file_path = e.file_path
    where e.type in ('function', 'method') and starts_with(e.name, 'test_') and e.start_line is not null and e.end_line is not null and e.start_line <= len(f.rows)),
call as (select uuid as test, repo_id, unnest(list_distinct(regexp_extract_all(code, '(\w+)\(', 1))) as name from run),
subject as (select repo_id, name, min(uuid) as uuid from tested where type in ('function', 'method', 'class') group by 1, 2)
select c.test, s.uuid as subject, 0.6::double as confidence from call c join subject s on s.repo_id = c.repo_id and s.name = c.name
where c.name not in ('assert', 'assertEqual', 'assertTrue', 'mock', 'patch') and c.test <> s.uuid
""")

_CODE = _TEXT + """
, code as (select uuid, repo_id, file_path, name, type, start_line, end_line, array_to_string(rows[start_line:end_line], chr(10)) as code from placed where type in ('class', 'function', 'method'))
"""
_CLASS, _FUNCTION = "type = 'class'", "type = 'function'"


def _contains(text: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


_FIRST = (
    ("singleton", 0.8, f"{_CLASS} and {_contains('code', '_instance', '__new__')} and {_contains('code', 'getInstance', 'get_instance')}"),
    ("factory", 0.7, rf"type in ('class', 'function') and regexp_matches(code, 'return\s+\w+\s*\(') and {_contains('lower(name)', 'factory', 'create', 'build', 'make')}"),
    ("god_class", 0.8, rf"{_CLASS} and (end_line - start_line + 1 > 200 or len(regexp_extract_all(code, 'def\s+\w+')) > 20)"),
)
_EVERY = (
    ("long_parameter_list", 0.7, rf"{_FUNCTION} and len(list_filter(string_split(regexp_extract(code, 'def\s+\w+\s*\(([^)]*)\)', 1), ','), lambda x: trim(x) <> '')) > 5"),
    ("extract_method", 0.7, f"{_FUNCTION} and end_line - start_line + 1 > 30"),
)
graph("entity_patterns", _CODE + " union all ".join(
    f"select * from (select '{n}' as pattern, {c}::double as confidence, repo_id, file_path, uuid from code where {w} qualify row_number() over (partition by repo_id, file_path order by start_line, uuid) = 1)" for n, c, w in _FIRST
) + " union all " + " union all ".join(f"select '{n}', {c}, repo_id, file_path, uuid from code where {w}" for n, c, w in _EVERY))
_MVC = ("model", _contains("lower(name)", "model", "entity", "data")), ("view", _contains("lower(name)", "view", "template", "ui")), ("controller", _contains("lower(name)", "controller", "handler", "action"))
_ROLES = (
    ("observer", "subject", f"{_contains('code', 'observers', 'listeners')} and {_contains('code', 'notify', 'update')}"),
    ("observer", "observer", _contains("code", "update", "on_notify")),
    ("strategy", "strategy", f"{_contains('lower(name)', 'strategy', 'algorithm', 'policy')} and {_contains('code', 'execute', 'apply', 'perform')}"),
    ("strategy", "context", f"contains(lower(code), 'strategy') and {_contains('code', 'set_strategy', 'setStrategy')}"),
    ("decorator_pattern", "decorator", f"contains(lower(code), 'component') and {_contains('code', 'delegate', 'forward', 'proxy')}"),
    ("repository", "repository", f"contains(lower(name), 'repository') and {_contains('lower(code)', 'find', 'save', 'delete', 'create', 'update')}"),
    ("service_layer", "service", f"contains(lower(name), 'service') and {_contains('lower(code)', 'process', 'handle', 'execute', 'perform')}"),
)
_PLAYED = _CODE + ", played as (select repo_id, file_path, uuid, start_line, end_line, 'mvc' as pattern, case " + " ".join(f"when {c} then '{r}'" for r, c in _MVC) + f""" end as role from entity where {_CLASS}
    union all select repo_id, file_path, uuid, start_line, end_line, 'extract_class', 'function' from entity where {_FUNCTION}
    """ + " ".join(f"union all select repo_id, file_path, uuid, start_line, end_line, '{p}', '{r}' from code where {_CLASS} and {c}" for p, r, c in _ROLES) + """
), group_ as (
    select pattern, repo_id, file_path, count(distinct role) as roles, count(*) as n, min(start_line) as start_line, max(end_line) as end_line from played where role is not null group by all
), needed(pattern, confidence, k) as (values ('mvc', 0.7::double, 3), ('observer', 0.8, 2), ('strategy', 0.8, 2), ('decorator_pattern', 0.7, 1), ('repository', 0.8, 1), ('service_layer', 0.7, 1), ('extract_class', 0.6, 1)),
kept as (select g.*, confidence from group_ g join needed d on d.pattern = g.pattern and d.k = g.roles where g.pattern <> 'extract_class' or g.n > 10),
evidence as (select pattern, repo_id, file_path, role || ':' || count(*) as said from played where role is not null group by pattern, repo_id, file_path, role)
"""
_SAME = "p.pattern = k.pattern and p.repo_id is not distinct from k.repo_id and p.file_path is not distinct from k.file_path"
graph("file_patterns", _PLAYED + f"""
select k.pattern, k.confidence, k.repo_id, k.file_path, k.start_line, k.end_line, k.n as entities, string_agg(p.said, ',' order by p.said) as evidence from kept k join evidence p on {_SAME} group by all
""")
graph("pattern_members", _PLAYED + "select p.pattern, p.role, p.repo_id, p.file_path, p.uuid from played p join kept k on p.pattern = k.pattern and p.repo_id = k.repo_id and p.file_path = k.file_path where p.role is not null")
graph("signatures", _TEXT + """
, head as (select uuid, rows[greatest(start_line, 1):greatest(start_line, 1) + 5] as h from placed where type in ('function', 'method'))
select uuid, ltrim(array_to_string(list_transform(h[1:coalesce(nullif(list_position(list_transform(h, lambda x: contains(x, ':')), true), 0), len(h))], lambda x: trim(x)), ' ')) as signature from head
""")
_NEAR = "array_to_string(rows[greatest(start_line - 2, 1):end_line + 3], chr(10))"
_CONTEXTUAL = f"""
, near as (select uuid, name, type, file_path, {_NEAR} as text from placed),
contextual as (
    select uuid as base, 'api_' || name as name, 'endpoint' as type, 0.8::double as confidence, 'API,ENDPOINT,ENHANCED' as tags from near where type = 'function' and {_contains('text', '@app.route', '@app.get', '@app.post', 'request', 'response', 'HTTP', 'API')}
    union all select uuid, 'test_util_' || name, 'test', 0.7, 'TEST,UTILITY,ENHANCED' from near where type = 'function' and not starts_with(name, 'test_') and {_contains('text', 'assert', 'pytest', 'unittest', 'mock', 'test_', '@pytest')}
    union all select uuid, 'model_' || name, 'model', 0.8, 'MODEL,DATA,ENHANCED' from near where type = 'class' and {_contains('text', 'pydantic', 'BaseModel', 'dataclass', 'SQLAlchemy', 'Table', 'Column', 'relationship')}
    union all select uuid, 'util_' || name, 'utility', 0.7, 'UTILITY,HELPER,ENHANCED' from near where type = 'function' and (regexp_matches(lower(name), 'helper|util|tool|common|shared') or regexp_matches(lower(file_path), 'helper|util|tool|common|shared'))
)
"""
graph("contextual_entities", _TEXT + _CONTEXTUAL + "select * from contextual")
graph("config_usage", _TEXT + r"""
, config as (
    select repo_id, name as word, min(uuid) as config from entity where list_contains(coalesce(tags, []), 'CONFIG') or (upper(name) = name and regexp_matches(name, '[A-Z]')) group by 1, 2
), numbered as (select repo_id, file_path, unnest(rows) as text, generate_subscripts(rows, 1) as line from file),
used as (
    select distinct n.repo_id, n.file_path, n.line, c.config from (select repo_id, file_path, line, unnest(list_distinct(regexp_split_to_array(text, '\W+'))) as word from numbered) n
    join config c on c.repo_id = n.repo_id and c.word = n.word where length(n.word) > 1
), around as (
    select u.*, e.uuid from used u join entity e on e.repo_id = u.repo_id and e.file_path = u.file_path and e.end_line >= e.start_line and u.line between e.start_line and e.end_line
    qualify row_number() over (partition by u.repo_id, u.file_path, u.line, u.config order by e.end_line - e.start_line, e.uuid) = 1
)
select distinct config, uuid from around where config <> uuid
""")
_HANDLER = r"""(\w+)\s*=\s*\{[^}]*["'](\w+)["']\s*:\s*(\w+)"""
SQL["handlers"] = _PY + f"select repo_id, file_path, {_LINE_NO} as line, g1 as holder, g2 as key, g3 as function from {_found('file', _HANDLER, 3)}"
graph("dictionary_handlers", """
, named as (select repo_id, file_path, name, arg_min(uuid, {'a': start_line, 'b': uuid}) as uuid from entity group by 1, 2, 3),
ends_ as (select repo_id, file_path, min(name) as a, max(name) as b from entity where regexp_matches(name, '^[A-Za-z0-9_]+$') and ends_with(file_path, '.py') group by 1, 2)
select e.repo_id, e.file_path, 'key' as key, x.uuid as source, y.uuid as target, 0.8::double as confidence
from ends_ e join named x on x.repo_id = e.repo_id and x.file_path = e.file_path and x.name = e.a join named y on y.repo_id = e.repo_id and y.file_path = e.file_path and y.name = e.b
""")
_TAGS_OF = {
    "flask_route": "API,FLASK,ENDPOINT", "fastapi_endpoint": "API,FASTAPI,ENDPOINT", "decorator": "DECORATOR", "constants": "CONSTANT", "exception_class": "EXCEPTION,CLASS", "test_function": "TEST,FUNCTION",
    "model_class": "MODEL,CLASS", "utility_function": "UTILITY,FUNCTION",
}
_TAGGED = " ".join(f"when '{p}' then '{t}'" for p, t in _TAGS_OF.items())
graph("extracted_entities", _TEXT.replace("file as", "text_ as").replace("join file f", "join text_ f") + _CONTEXTUAL + _PY_LINE.replace("with file", ", file") + rf"""
, formed as ({_PATTERN_ENTITIES}),
bound as (
    select repo_id, file_path, n, regexp_extract(text, '^(\w+)\s*=\s*(.+)$', 1) as name, regexp_extract(text, '^(\w+)\s*=\s*(.+)$', 2) as value
    from line where regexp_matches(text, '^(\w+)\s*=\s*(.+)$') and not regexp_matches(text, '^\w+\s*=\s*=')
), held as (select repo_id, file_path, {_LINE_NO} as line, g1 || '[' || g2 || ']' as name, g1 as holder from {_found('file', _HANDLER, 3)}),
every as (
    select distinct repo_id, file_path, type, name, line, case pattern {_TAGGED} end as tags, pattern as way from formed
    union select repo_id, file_path, case when upper(name) = name and regexp_matches(name, '[A-Z]') then 'constant' else 'variable' end, name, cast(n as integer),
        case when upper(name) = name and regexp_matches(name, '[A-Z]') then 'CONSTANT,GLOBAL' else 'VARIABLE,GLOBAL' end, '' from bound where not regexp_matches(value, 'import|def |class ')
    union select repo_id, file_path, 'handler', name, line, 'HANDLER,MAPPING', holder from held
    union select e.repo_id, e.file_path, c.type, c.name, e.start_line, c.tags, base from contextual c join entity e on e.uuid = c.base
)
select repo_id, file_path, type, tags, count(*) as n from every group by all
""")

# ------------------------------------------------------------------------------------------------ changes and audit

graph("upsert_last_wins", "select src, dst, type, uuid from link")
graph("delete_cascade", "select src as from_uuid, dst as to_uuid, type from link where src not in (select uuid from entity where type = 'external') and dst not in (select uuid from entity where type = 'external')")
SQL["patch_update"] = """
with first as (select min(uuid) as u from nodes where type = 'function')
select uuid, case when uuid = u then 'renamed' else name end as name, case when uuid = u then null else docstring end as docstring,
       cast(case when uuid = u then coalesce(len(history), 0) + 1 else len(history) end as integer) as n_history from nodes, first
"""
graph("rejected_relations", "select src as from_uuid, dst as to_uuid, type from link where src not in (select uuid from entity) or dst not in (select uuid from entity)")
graph("ingest_audit", """select created_at as "timestamp", 'system' as "user", 'add_node' as action, 'node' as entity_type, uuid as entity_uuid from entity""")
graph("created_entities", """
, made as (select 'made-' || repo_id as uuid, repo_id, 'readme' as name, 'module' as type, true as manual from repos union all select min(uuid), repo_id, 'again', 'class', true from nodes where uuid is not null group by repo_id)
select * from made union select uuid, repo_id, name, type, manual from nodes where uuid is not null and uuid not in (select uuid from made)
""")
graph("accepted_relations", """
, ok as (select src, dst from link where src in (select uuid from entity) and dst in (select uuid from entity))
select src as from_uuid, dst as to_uuid, type || '!' as type, true as manual from link semi join ok using (src, dst)
union all select src, dst, type, cast(null as boolean) from link anti join ok using (src, dst) where type = 'imports'
""")
SQL["stored_nodes"] = "select uuid, repo_id, name, type, created_at from nodes where uuid is not null and repo_id is not null and file_path is not null and type is not null and name is not null and created_by is not null"
SQL["stored_edges"] = "select uuid, from_uuid, to_uuid, type from edges where uuid is not null and from_uuid is not null and to_uuid is not null and type is not null and created_by is not null"
graph("stored_index", "select uuid, case when type = 'class' then 'new ' || name else name end as name, type, start_line, left(docstring, 100) as short_doc from entity")
SQL["stored_log"] = 'select uuid, "timestamp", action, entity_uuid from (select distinct * from audit) where "timestamp" is not null'
SQL["deleted_repository"] = """
with first as (select min(repo_id) as r from nodes), gone as (select distinct uuid from nodes, first where repo_id = r),
lost as (select distinct uuid from edges where from_uuid in (select uuid from gone) or to_uuid in (select uuid from gone)), thing as (select uuid from gone union select uuid from lost)
select 'nodes' as name, count(*) as n from nodes, first where repo_id <> r
union all select 'edges', count(*) from edges where uuid is null or uuid not in (select uuid from lost where uuid is not null)
union all select 'audit', count(*) from (select distinct * from audit), first
    where (entity_uuid is null or entity_uuid not in (select uuid from thing where uuid is not null)) and coalesce(entity_type <> 'repo' or entity_uuid <> r, true)
"""
SQL["parsed_javascript"] = _FILE + ", js as (select repo_id, file_path, replace(content, chr(13) || chr(10), chr(10)) as content from file where content is not null and regexp_matches(lower(file_path), '\\.(js|jsx|ts|tsx)$'))\n" + " union all ".join(
    f"select repo_id, file_path, g1 as name, '{t}' as type, '{k}' as form, {_LINE_NO} as line from {_found('js', p, 1)} where {w}"
    for t, k, p, w in (
        ("class", "class", r"class\s+(\w+)\s*(?:extends\s+\w+)?\s*\{", "true"),
        ("function", "function", r"function\s+(\w+)\s*\(", "g1 not in ('if', 'for', 'while', 'switch', 'catch')"),
        ("function", "method", r"(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", "g1 not in ('if', 'for', 'while', 'switch', 'catch')"),
        ("function", "arrow_function", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", "g1 not in ('if', 'for', 'while', 'switch', 'catch')"),
    )
)
SQL["javascript_tags"] = f"""
select distinct repo_id, file_path, case form when 'class' then 'definition.class' when 'method' then 'definition.method' else 'definition.function' end as tag, name, line
from ({SQL['parsed_javascript']}) where form <> 'method' or name <> 'constructor'
"""
SQL["audit_deduplicated"] = 'select distinct uuid from audit where "timestamp" is not null'
SQL["audit_stream_latest"] = """
select entity_uuid, "timestamp", uuid from audit where "timestamp" is not null qualify row_number() over (partition by entity_uuid order by "timestamp" desc, uuid desc) = 1
"""
SQL["audit_page"] = """select * from (select distinct * from audit where "timestamp" is not null) order by "timestamp", uuid limit 100 offset 50"""
SQL["audit_by_entity"] = """
with event as (select distinct * from audit),
top as (select lower(trim(entity_uuid)) as e from event where entity_type = 'node' group by 1 order by count(*) desc, 1 limit 1)
select event.* from event, top where lower(trim(entity_uuid)) = e
"""
SQL["audit_windowed_counts"] = """
select date_trunc('day', "timestamp")::timestamp as start, lower(trim(action)) as action, count(*) as n from audit where "timestamp" is not null group by 1, 2
"""
