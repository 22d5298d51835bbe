"""The same results in SQL, recomputed from the given tables.

All queries share one list of common table expressions and differ in the last SELECT.
Patterns are written for RE2, apart from the Spark side. Only fixed values (planted
lines, rule texts) are shared.
"""

from __future__ import annotations

import re

from checks import planted as P
from checks.queries import CUSTOM_RULE
from wardlake import __version__
from wardlake.functions.text import JS_SPACE
from wardlake.operators import code_rules, docker, env_files, secrets, workflows
from wardlake.operators.changes import MANIFEST_NAMES
from wardlake.operators.rules import Rule
from wardlake.plans.report import FINGERPRINT_KEY, SARIF_SCHEMA, SARIF_VERSION, TOOL_NAME
from wardlake.sources.corpus import ALWAYS_SKIPPED, MAX_FILE_BYTES, NON_PRODUCTION, SCANNED_EXTENSIONS


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


W = r"[\s\v\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NW = r"[^\s\v\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SPACE = q(JS_SPACE)


def trim(x: str) -> str:
    return f"trim({x}, {SPACE})"


EXCERPT = f"substr({trim('line')}, 1, 120)"

CTES: dict[str, str] = {}

# ---------------------------------------------------------------- planted inputs


def _kinds() -> str:
    rows = []
    for code, kind in P.KINDS.items():
        before, after = kind.path.split("{n}")
        tail = q("\n".join(kind.lines))
        if code == P.BIG_KIND:
            tail = f"repeat({tail}, {P.BIG_REPEAT})"
        rows.append(f"({code}, {q(before)}, {q(after)}, {q(kind.comment)}, {tail})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(kind, before, after, comment, tail)"


CTES["kinds"] = _kinds()
_instead = " ".join(f"WHEN k = {k} AND doc_id % {n} = {r} THEN {other}" for k, (n, r, other) in P.INSTEAD.items())
CTES["planted"] = f"""
SELECT doc_id, kind, 'repo_' || source AS repo, before || CAST(doc_id AS VARCHAR) || after AS path,
  comment || replace(text, chr(10), chr(10) || comment) || chr(10) || tail AS content
FROM (SELECT doc_id, source, text, CASE {_instead} ELSE k END AS kind
      FROM (SELECT *, CAST(floor(doc_id / 20) AS INTEGER) % {P.KIND_COUNT} AS k FROM documents)) d
JOIN kinds USING (kind)"""
_ignore_text = q("\n".join(P.IGNORE_LINES) + "\n")
CTES["ignore_files"] = f"""
SELECT DISTINCT 'repo_' || source AS repo, '.scannerignore' AS path, {_ignore_text} ||
  CASE WHEN CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 2 = 0 THEN {q(P.IGNORE_GLOBAL + chr(10))} ELSE '' END AS content
FROM documents"""
CTES["packages"] = f"""
SELECT p_partkey AS key, p_partkey // {P.PARTS_PER_REPO} AS g, p_size,
  CASE WHEN p_partkey % 5 = 2 THEN '@s/' ELSE '' END || replace(p_name, ' ', '-') || '-' || (p_partkey % {P.NAME_CYCLE}) AS name,
  (1 + p_size % 5) || '.' || (p_partkey % 20) || '.' || (p_partkey % 7) AS version
FROM part"""
_spec = " ".join(
    f"WHEN {i} THEN {q(s)}" if "{v}" not in s else f"WHEN {i} THEN {q(s.split('{v}')[0])} || version || {q(s.split('{v}')[1])}"
    for i, s in enumerate(P.SPECIFIERS)
)
CTES["package_texts"] = f"""
SELECT key, g,
  CASE key % 5
    WHEN 0 THEN '"node_modules/' || name || '":{{"version":"' || version || '"}}'
    WHEN 1 THEN '"node_modules/' || name || '":{{"version":"' || version || '"}},"node_modules/host/node_modules/' || name || '":{{"version":"' || version || '"}}'
    WHEN 2 THEN '"node_modules/' || name || '":{{"version":"0.0.' || (key % 7) || '"}},"node_modules/' || name || '":{{"version":"' || version || '"}}'
    WHEN 3 THEN '"node_modules/' || name || '":' || CASE key % 15 WHEN 3 THEN '"odd"' WHEN 8 THEN 'null' ELSE '{{"link":true}}' END
    ELSE '"packages/' || name || '":{{"version":"' || version || '"}},"node_modules/a/node_modules/' || name || '":{{"version":"9.0.' || (key % 7) || '"}}'
  END AS lock_text,
  CASE WHEN key % 2 = 0 THEN CASE WHEN key % 8 = 0 THEN '"' || name || '":"^0.0.1",' ELSE '' END || '"' || name || '":"' || CASE key % 11 {_spec} END || '"' END AS dep_text,
  CASE WHEN key % 3 = 0 THEN '"' || name || '":"~8.' || (key % 20) || '"' END AS dev_text
FROM packages"""
CTES["dependency_docs"] = """
SELECT g, string_agg(lock_text, ',' ORDER BY key) AS lock_texts,
  coalesce(string_agg(dep_text, ',' ORDER BY key), '') AS dep_texts,
  coalesce(string_agg(dev_text, ',' ORDER BY key), '') AS dev_texts
FROM package_texts GROUP BY g"""
CTES["dependency_files"] = """
SELECT 'dep_' || g AS repo, 'package-lock.json' AS path,
  CASE WHEN g % 9 = 2 THEN '{"packages":{}}' WHEN g % 9 = 5 THEN 'not json'
    ELSE '{"lockfileVersion":3,"packages":{"":{"version":"1.0.0"},' || lock_texts || '}}' END AS content
FROM dependency_docs WHERE g % 3 <> 0
UNION ALL
SELECT 'dep_' || g, 'package.json', CASE WHEN g % 12 = 3 THEN '{"name": "app", "dependencies": {'
    ELSE '{"name":"app","dependencies":{' || dep_texts || '},"devDependencies":{' || dev_texts || '}}' END
FROM dependency_docs"""
CTES["corpus"] = """
SELECT repo, path, content FROM planted UNION ALL SELECT repo, path, content FROM ignore_files
UNION ALL SELECT repo, path, content FROM dependency_files"""
CTES["texts"] = """
SELECT source AS repo, 'src/' || source || '/d' || doc_id || '.js' AS path, text AS content FROM documents
UNION ALL SELECT 'pages', 'src/p' || page_id || '.js', html FROM pages"""
CTES["tracked"] = f"SELECT repo, path FROM planted WHERE kind <> {P.UNTRACKED_KIND}"
_metrics = " || ".join(
    f"'/{n}:' || substr('{letters}', CAST(floor(key / {step}) AS INTEGER) % {len(letters)} + 1, 1)"
    for n, letters, step in P.CVSS_LETTERS[:-1]
)
_n, _letters, _step = P.CVSS_LETTERS[-1]
CTES["vectors"] = f"""
SELECT key, CASE WHEN key % 17 = 0 THEN 'CVSS:2.0' WHEN key % 2 = 0 THEN 'CVSS:3.0' ELSE 'CVSS:3.1' END || {_metrics}
  || CASE WHEN key % 13 = 0 THEN '' ELSE '/{_n}:' || substr('{_letters}', CAST(floor(key / {_step}) AS INTEGER) % {len(_letters)} + 1, 1) END
  || CASE WHEN key % 19 = 0 THEN '/AV:P' ELSE '' END AS vector
FROM packages"""
_labels = " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(P.DB_SEVERITIES) if x)
CTES["advisories"] = f"""
SELECT s_suppkey AS s, 'ADV-' || s_suppkey AS id, p.name, p.version, p.p_size,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'Flaw in ' || p.name || {q(" " + P.LONG_TAIL)} END AS summary,
  CASE s_suppkey % 7 {_labels} END AS db_severity,
  CASE s_suppkey % 5 WHEN 1 THEN v.vector WHEN 2 THEN 'CVSS:3.1/broken' WHEN 3 THEN v.vector END AS v3_score
FROM supplier JOIN packages p ON p.key = s_suppkey * 19 JOIN vectors v ON v.key = p.key"""


def _base(cte: str, key: str, vector: str, source: str) -> None:
    """Adds a CTE with the CVSS base score of every row's vector."""

    def metric(name: str) -> str:
        return f"regexp_extract_all({vector}, '/{name}:([^:/]+)', 1)[-1]"

    def weights(letter: str, **table: str) -> str:
        return f"CASE {letter} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"

    impact = dict(H="0.56", L="0.22", N="0")
    CTES[cte + "_w"] = f"""
SELECT {key}, {vector} AS vector, {metric("S")} AS sc,
  {weights(metric("AV"), N="0.85", A="0.62", L="0.55", P="0.2")} AS av,
  {weights(metric("AC"), L="0.77", H="0.44")} AS ac,
  {weights(metric("UI"), N="0.85", R="0.62")} AS ui,
  CASE WHEN {metric("S")} = 'C' THEN {weights(metric("PR"), N="0.85", L="0.68", H="0.5")}
    ELSE {weights(metric("PR"), N="0.85", L="0.62", H="0.27")} END AS pr,
  {weights(metric("C"), **impact)} AS c, {weights(metric("I"), **impact)} AS i, {weights(metric("A"), **impact)} AS a
FROM {source}"""
    CTES[cte + "_p"] = f"""
SELECT *, CASE WHEN sc = 'U' THEN 6.42::DOUBLE * iss
    ELSE 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) END AS impact,
  8.22::DOUBLE * av * ac * pr * ui AS expl
FROM (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM {cte}_w)"""
    CTES[cte] = f"""
SELECT {key}, vector, CASE WHEN NOT regexp_matches(vector, '^CVSS:3\\.[01]/') OR sc NOT IN ('U', 'C') OR sc IS NULL
    OR impact IS NULL OR expl IS NULL THEN NULL WHEN impact <= 0 THEN 0::DOUBLE
  WHEN scaled % 10000 = 0 THEN scaled / 100000::DOUBLE ELSE (scaled // 10000 + 1) / 10::DOUBLE END AS base_score
FROM (SELECT *, CAST(floor(least(CASE WHEN sc = 'C' THEN 1.08::DOUBLE ELSE 1 END * (impact + expl), 10) * 100000 + 0.5) AS BIGINT) AS scaled
  FROM {cte}_p)"""


_base("part_scores", "key", "vector", "vectors")
_base("advisory_scores", "s", "v3_score", "advisories")
CTES["rated_advisories"] = """
SELECT a.*, CASE WHEN upper(db_severity) = 'CRITICAL' THEN 'critical' WHEN upper(db_severity) = 'HIGH' THEN 'high'
  WHEN upper(db_severity) IN ('MODERATE', 'MEDIUM') THEN 'medium' WHEN upper(db_severity) = 'LOW' THEN 'low'
  WHEN base_score >= 9 THEN 'critical' WHEN base_score >= 7 THEN 'high' WHEN base_score >= 4 THEN 'medium'
  WHEN base_score IS NOT NULL THEN 'low' ELSE 'medium' END AS severity
FROM advisories a JOIN advisory_scores USING (s)"""

# ---------------------------------------------------------------- files and lines

CTES["files"] = "SELECT * FROM corpus UNION ALL SELECT * FROM texts"


def routed(source: str) -> str:
    return rf"""
SELECT *, strlen(content) AS size, lb = 'dockerfile' OR starts_with(lb, 'dockerfile.') OR ext = '.dockerfile' AS is_dockerfile,
  starts_with(path, '.github/workflows/') AND ext IN ('.yml', '.yaml') AS is_workflow,
  regexp_matches(path, '\.(js|jsx|ts|tsx|mjs|cjs)$')
    AND NOT (lb = 'dockerfile' OR starts_with(lb, 'dockerfile.') OR ext = '.dockerfile') AS is_code
FROM (SELECT *, lower(base) AS lb, lower(regexp_extract(base, '^(?s:.+)(\.[^.]*)$', 1)) AS ext,
    list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) AS dirs
  FROM (SELECT *, string_split(path, '/')[-1] AS base FROM {source}))"""


SCANNABLE = f"(ext IN ({names(SCANNED_EXTENSIONS)}) OR starts_with(base, '.env') OR is_dockerfile)"


def not_below(dirs) -> str:
    return f"NOT list_has_any(dirs, [{names(dirs)}])"


DEFAULT_SKIPPED = (*ALWAYS_SKIPPED, *NON_PRODUCTION)
SCANNED = f"{SCANNABLE} AND {not_below(DEFAULT_SKIPPED)}"
SCANNED_WITH_TESTS = f"{SCANNABLE} AND {not_below(ALWAYS_SKIPPED)}"

MASK = (
    r'"(?:[^"\\]|\\.)*"'
    r"|'(?:[^'\\]|\\.)*'"
    r"|`(?:[^`\\$]|\\.|\$+[^`{\\$]|\$+\\.)*\$*`"
    r"|//.*"
    r"|/\*.*?\*/"
)
HAS_DIRECTIVE = rf"regexp_matches(line, '(?i)//{W}*scanner-ignore')"
DIRECTIVE_IDS = (
    f"list_filter(list_transform(string_split(regexp_extract(line, '(?i)//{W}*scanner-ignore(?::{W}*(.+))?', 1), ','),"
    f" lambda x: {trim('x')}), lambda x: x <> '')"
)


def lines_of(source: str) -> str:
    return rf"""
SELECT *, is_code AND (starts_with({trim("line")}, '//') OR starts_with({trim("line")}, '*')) AS comment
FROM (SELECT repo, path, is_dockerfile, is_code, is_workflow, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
  FROM (SELECT *, string_split_regex(content, '\r?\n') AS ls FROM {source}))"""


# ---------------------------------------------------------------- rules

BINDINGS = {
    "import_names": r"import\s*(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['\"]child_process['\"]",
    "import_whole": r"import\s+(?:\*\s+as\s+)?([\w$]+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*['\"]child_process['\"]",
    "require_names": r"(?:const|let|var)\s*\{([^{}]*\}\s*=\s*require\s*\(\s*['\"]child_process['\"]\s*\)\s*\.?)",
    "require_whole": r"(?:const|let|var)\s+([\w$]+\s*=\s*require\s*\(\s*['\"]child_process['\"]\s*\)(?:\s*\.\s*[\w$]+)?\s*[.(\[]?)",
}
SENSITIVE = "token|secret|password|otp|nonce|salt"
MASKED = f"regexp_replace(line, {q(MASK)}, '\"\"', 'g')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def bindings_of(source: str) -> str:
    def every(name: str) -> str:
        return f"SELECT repo, path, unnest(regexp_extract_all(content, {q(BINDINGS[name])}, 1)) AS t FROM {source} WHERE is_code"

    return rf"""
SELECT DISTINCT repo, path, kind, name FROM (
  SELECT repo, path, 'direct' AS kind, regexp_extract(i, '([\w$]+)\s*$', 1) AS name
    FROM (SELECT repo, path, unnest(string_split(t, ',')) AS i FROM ({every("import_names")}))
  UNION ALL SELECT repo, path, 'direct', regexp_extract(i, '^\s*(?:[^:]*:\s*)?([\w$]+)\s*$', 1)
    FROM (SELECT repo, path, unnest(string_split(split_part(t, '}}', 1), ',')) AS i FROM ({every("require_names")}) WHERE NOT ends_with(t, '.'))
  UNION ALL SELECT repo, path, 'direct', regexp_extract(t, '^([\w$]+)(?s:.)*\.\s*(?:execSync|exec)\s*$', 1) FROM ({every("require_whole")})
  UNION ALL SELECT repo, path, 'namespace', t FROM ({every("import_whole")})
  UNION ALL SELECT repo, path, 'namespace', regexp_extract(t, '^([\w$]+)(?s:.)*\)\s*$', 1) FROM ({every("require_whole")})
) WHERE name <> ''"""


def described(rule: Rule) -> str:
    return (
        f"repo, {q(rule.rule_id)} AS rule_id, {q(rule.category)} AS category, {q(rule.severity)} AS severity, "
        f"{q(rule.title)} AS title, path, %s AS line, %s AS excerpt, {q(rule.remediation)} AS remediation, "
        f"0 AS phase, {rule.check_order} AS chk, CAST(%s AS BIGINT) AS occ"
    )


def counted(rule: Rule, number: str, where: str, lines: str) -> str:
    """A rule that reports a line as often as ``number`` says."""
    columns = described(rule) % ("CAST(line_no AS INTEGER)", EXCERPT, "o")
    return (
        f"SELECT {columns} FROM (SELECT *, unnest(range(n)) AS o FROM "
        f"(SELECT *, CAST({number} AS BIGINT) AS n FROM {lines} WHERE {where}) WHERE n > 0)"
    )


def matching(rule: Rule, condition: str, where: str, lines: str, excerpt: str = EXCERPT) -> str:
    columns = described(rule) % ("CAST(line_no AS INTEGER)", excerpt, "0")
    return f"SELECT {columns} FROM {lines} WHERE {where} AND {condition}"


SECRET_PATTERNS = {
    secrets.AWS_ACCESS_KEY: ("AKIA[0-9A-Z]{16}", 0),
    secrets.PRIVATE_KEY: ("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0),
    secrets.API_KEY: (rf"(?i)api[_-]?key['\"]?{W}*[:=]{W}*['\"]([A-Za-z0-9_-]{{16,}})['\"]", 1),
    secrets.JWT_SECRET: (rf"(?i)jwt[_-]?secret['\"]?{W}*[:=]{W}*['\"]([^'\"]{{8,}})['\"]", 1),
    secrets.BEARER_TOKEN: (rf"(?i)bearer{W}+([A-Za-z0-9._~+/-]{{16,}})", 1),
    secrets.HARDCODED_PASSWORD: (rf"(?i)(?:password|passwd|pwd)['\"]?{W}*[:=]{W}*['\"]([^'\"]{{6,}})['\"]", 1),
    secrets.GENERIC_TOKEN: (rf"(?i)token['\"]?{W}*[:=]{W}*['\"]([A-Za-z0-9]{{32,}})['\"]", 1),
}


def secret(rule: Rule, lines: str) -> str:
    pattern, group = SECRET_PATTERNS[rule]
    number = list(SECRET_PATTERNS).index(rule)
    masked = "CASE WHEN length(v) < 12 THEN '****' ELSE left(v, 4) || '****' || right(v, 4) END"
    columns = described(rule) % ("CAST(line_no AS INTEGER)", masked, f"{number} * 100000 + o")
    values = f"regexp_extract_all(line, {q(pattern)}, {group})"
    return (
        f"SELECT {columns} FROM (SELECT *, unnest(vs) AS v, generate_subscripts(vs, 1) AS o "
        f"FROM (SELECT *, {values} AS vs FROM {lines}))"
    )


PLAIN_CODE = "is_code AND NOT comment"
# What is found in the planted sources, line by line: path, line, rule, how often. Fixed by hand, from what each line means.
EXPECTED = [
    ("src/f%.ts", "exec(`ls ${d}`);", code_rules.EXEC, 1),
    ("src/f%.ts", 'exec("ls " + d);', code_rules.EXEC, 1),
    ("lib/f%.js", "eval(body);", code_rules.EVAL, 1),
    ("lib/f%.js", "eval(other);", code_rules.EVAL, 1),
    ("test/f%.js", "eval(x);", code_rules.EVAL, 1),
    ("src/tls%.js", "const a = { rejectUnauthorized: false };", code_rules.TLS, 1),
    ("src/tls%.js", "process.env.NODE_TLS_REJECT_UNAUTHORIZED = '0';", code_rules.TLS, 1),
    ("src/tls%.js", 'process.env["NODE_TLS_REJECT_UNAUTHORIZED"] = "0";', code_rules.TLS, 1),
    ("src/tls%.js", "f({ rejectUnauthorized: false }, { rejectUnauthorized: false });", code_rules.TLS, 2),
    ("src/cors%.js", 'app.use(cors({ origin: "*" }));', code_rules.CORS, 1),
    ("src/cors%.js", "app.use(cors({ credentials: true, origin: '*' }));", code_rules.CORS, 1),
    ("src/cors%.js", "app.use(cors({ headers: { a: 1 }, origin: '*' }));", code_rules.CORS, 1),
    ("src/cors%.js", "app.use(cors({", code_rules.CORS, 1),
    ("src/cors%.js", "  rejectUnauthorized:", code_rules.TLS, 1),
    ("src/rnd%.js", "const token = Math.random();", code_rules.WEAK_RANDOM, 1),
    ("src/rnd%.js", "const o = { nonce: Math.random() };", code_rules.WEAK_RANDOM, 1),
    ("src/rnd%.js", "this.resetPassword = Math.random();", code_rules.WEAK_RANDOM, 1),
    ("src/rnd%.js", "const otp =", code_rules.WEAK_RANDOM, 1),
    ("src/eval%.js", "const f = new Function(b);", code_rules.NEW_FUNCTION, 1),
    ("src/eval%.js", "eval(a); eval(eval(b));", code_rules.EVAL, 3),
    ("src/eval%.js", " * eval(c) in a block comment", code_rules.EVAL, 1),
    ("src/ns%.js", "cp.exec(cmd);", code_rules.EXEC, 1),
    ("src/ns%.js", "run(cp.execSync(cmd));", code_rules.EXEC, 1),
    ("src/ns%.js", "cp.exec(", code_rules.EXEC, 1),
    ("src/ns%.js", "*/ eval(d", code_rules.EVAL, 1),
    ("src/ns%.js", "  * eval(f);", code_rules.EVAL, 1),
    ("src/mem%.js", "execSync(cmd);", code_rules.EXEC, 1),
    ("src/big%.js", "eval(z); // scanner-ignored", code_rules.EVAL, 1),
    ("vendor/f%.js", "eval(x);", code_rules.EVAL, 1),
    ("src/tpl%.js", "eval(z);", code_rules.EVAL, 1),
    ("src/tpl%.js", "const b = `w ${f(`eval(b) ${eval(c)}`, 'eval(d) }')} v`;", code_rules.EVAL, 1),
    ("src/tpl%.js", "if (x) /`/.test(y); eval(e); const r = `${{ k: { l: `${eval(g)}` } }}`;", code_rules.EVAL, 2),
    ("src/tpl%.js", "const u = `http://h/${p}`; eval(h) / 2; /* eval(i)", code_rules.EVAL, 1),
    # a source that does not close: plain patterns, once a line
    ("lib/broken%.js", "math.eval(c); eval(d);", code_rules.EVAL, 1),
    ("lib/broken%.js", "exec(`ls ${d}`);", code_rules.EXEC, 1),
    ("lib/broken%.js", "const token = g(Math.random());", code_rules.WEAK_RANDOM, 1),
    ("lib/broken%.js", "x.cors({ origin: '*' });", code_rules.CORS, 1),
    ("lib/broken%.js", "new  Function (x);", code_rules.NEW_FUNCTION, 1),
    # what an edit adds
    ("%", "eval(added);", code_rules.EVAL, 1),
]
CONSTRUCTS = {rule for _, _, rule, _ in EXPECTED}


def construct(rule: Rule, suffix: str) -> str:
    rows = ", ".join(f"({q(path)}, {q(line)}, {many})" for path, line, own, many in EXPECTED if own is rule)
    lines = f"(SELECT l.*, e.many FROM lines{suffix} l JOIN (VALUES {rows}) e(paths, wanted, many) ON l.line = e.wanted AND (l.path LIKE e.paths OR l.path LIKE 'gone/' || e.paths))"
    return counted(rule, "many", "is_code", lines)


# The planted sources without comments, hidden strings empty and hidden text of templates as #, by hand. The text before them is comments.
MASKED_LINES = {
    "src/f%.ts": ('const { exec } = require("child_process");', "exec(`##${d}`);", 'exec("ls");', 'exec("" + d);', "exec();", "execSync(d);"),
    "lib/f%.js": ("", "eval(body);", "eval(other);"),
    "src/eval%.js": ('const s = ""; ', "mathx.eval(a);", "const f = new Function(b);", "eval(a); eval(eval(b));", " * eval(c) in a block comment"),
    "src/ns%.js": (
        'import * as cp from "child_process";', "cp.exec(cmd);", 'cp.execSync("ls");', "run(cp.execSync(cmd));", "cp.exec(", "  cmd,", ");",
        "cp.exec( ", '  "ls"', ");", "", "", " eval(d", ");", "const t = `", "#`;", "const n = 2", "  * eval(f);",
    ),
    "src/tpl%.js": (
        "const a = `#${ y}`;".replace("{ ", "{"), "eval(z);", 'const b = `#${f(`#${eval(c)}`, "")}#`;',
        'if (x) "".test(y); eval(e); const r = `${{ k: { l: `${eval(g)}` } }}`;', "const u = `#${p}`; eval(h) / 2; ", " const t = `#", "#`;",
    ),
}


def masked_sql() -> str:
    rows = ", ".join(
        f"({q(path)}, {k - len(lines)}, {q(re.sub('#+', '#', line).strip())})" for path, lines in MASKED_LINES.items() for k, line in enumerate(lines)
    )
    return f"""SELECT repo, path, CAST(n + e.place + 1 AS INTEGER) AS line_no, e.code
FROM (SELECT repo, path, max(line_no) AS n FROM lines WHERE is_code AND repo LIKE 'repo_%' GROUP BY ALL) l
JOIN (VALUES {rows}) e(paths, place, code) ON l.path LIKE e.paths WHERE e.code <> ''"""


_plain_url = q("['\"]http://[^'\"]+['\"]")
MATCHING = {
    code_rules.INSECURE_HTTP: f"len(list_filter(regexp_extract_all(line, {_plain_url}), lambda x: NOT regexp_matches(x, '^.http://(localhost|127\\.0\\.0\\.1)'))) > 0",
    code_rules.EVAL_FALLBACK: f"regexp_matches(line, {q(rf'\beval{W}*\(')})",
    code_rules.NEW_FUNCTION_FALLBACK: f"regexp_matches(line, {q(rf'\bnew{W}+Function{W}*\(')})",
    code_rules.EXEC_FALLBACK: "regexp_matches(line, "
    + q(rf"\bexec(?:Sync)?{W}*\({W}*[`'\"].*\$\{{")
    + ")",
    code_rules.TLS_FALLBACK: "regexp_matches(line, "
    + q(rf"NODE_TLS_REJECT_UNAUTHORIZED{W}*[:=]{W}*['\"]?0|rejectUnauthorized{W}*:{W}*false")
    + ")",
    code_rules.CORS_FALLBACK: "regexp_matches(line, "
    + q(rf"cors{W}*\({W}*\{{[^}}]*origin{W}*:{W}*['\"]\*['\"]")
    + ")",
    code_rules.WEAK_RANDOM_FALLBACK: "regexp_matches(line, "
    + q(rf"(?i)\b(?:{SENSITIVE})\b[^\n;]*Math\.random{W}*\(")
    + ")",
}


IMAGE = f"regexp_extract({trim('line')}, {q(rf'(?i)^FROM{W}+(?:--{NW}+{W}+)*({NW}+)')}, 1)"
WHO = f"split_part(regexp_extract({trim('line')}, {q(rf'(?i)^USER{W}+({NW}+)')}, 1), ':', 1)"
PLAIN_USER = (
    f"regexp_matches({trim('line')}, {q(rf'(?i)^USER{W}+({NW}+)')}) AND {WHO} <> 'root' "
    f"AND NOT regexp_matches({WHO}, '^[+-]?0+([^0-9]|$)')"
)
SECRET_KEY = (
    r"(?i)(?:password|passwd|secret|token|api[_-]?key|auth(?:_?key)?|private[_-]?key"
    r"|credentials?|access[_-]?key|client[_-]?secret)\b"
)


def stages_of(lines: str) -> str:
    return f"""SELECT repo, path, line_no, nullif(image, '') AS image, plain,
      sum(CASE WHEN image <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY line_no) AS stage
    FROM (SELECT *, {IMAGE} AS image, {PLAIN_USER} AS plain FROM {lines} WHERE is_dockerfile)"""


def root_user(stages: str) -> str:
    columns = described(docker.ROOT_USER) % ("CAST(NULL AS INTEGER)", "CAST(NULL AS VARCHAR)", "0")
    return f"""SELECT {columns} FROM (SELECT repo, path FROM (SELECT *, max(stage) OVER (PARTITION BY repo, path) AS last FROM {stages})
      GROUP BY repo, path HAVING NOT bool_or(plain AND stage = last))"""


def latest_tag(lines: str) -> str:
    condition = (
        f"{IMAGE} <> '' AND lower({IMAGE}) <> 'scratch' AND NOT contains({IMAGE}, '@') "
        f"AND (NOT contains({IMAGE}, ':') OR substr({IMAGE}, instr({IMAGE}, ':') + 1) = 'latest')"
    )
    return matching(docker.LATEST_TAG, condition, "is_dockerfile", lines, trim("line"))


def env_secret(lines: str) -> str:
    value_ok = "v NOT IN ('', '\"\"', '''''') AND NOT starts_with(v, '$')"
    columns = described(docker.ENV_SECRET) % ("CAST(line_no AS INTEGER)", "shown", "o")
    body = f"SELECT *, {trim(f'substr({trim("line")}, 5)')} AS body FROM {lines} WHERE is_dockerfile AND regexp_matches({trim('line')}, {q(rf'(?i)^ENV{W}')})"
    firsts = f"SELECT *, regexp_extract(body, {q(rf'^{NW}*')}) AS head FROM ({body})"
    pair = q(rf"(?:^|{W})[A-Za-z_][A-Za-z0-9_]*={NW}*")
    return f"""SELECT {columns} FROM (
      SELECT *, 'ENV ' || k || '=***' AS shown FROM (
        SELECT *, {trim("split_part(t, '=', 1)")} AS k, substr(t, instr(t, '=') + 1) AS v
        FROM (SELECT repo, path, line_no, unnest(ts) AS t, generate_subscripts(ts, 1) AS o
          FROM (SELECT *, regexp_extract_all(body, {pair}) AS ts FROM ({firsts}) WHERE contains(head, '='))))
      WHERE regexp_matches(k, {q(SECRET_KEY)}) AND {value_ok}
      UNION ALL
      SELECT repo, path, line_no, head AS t, 0 AS o, head AS k, v, 'ENV ' || head || ' ***' AS shown FROM (
        SELECT *, {trim("substr(body, length(head) + 2)")} AS v FROM ({firsts}) WHERE NOT contains(head, '=') AND length(body) > length(head))
      WHERE regexp_matches(head, {q(SECRET_KEY)}) AND {value_ok})"""


REFERENCE = (
    f"regexp_replace(regexp_extract(split_part(line, '#', 1), {q(rf'^{W}*(?:-{W}+)?uses:{W}+({NW}+){W}*$')}, 1),"
    " '^[''\"]|[''\"]$', '', 'g')"
)


def unpinned(lines: str) -> str:
    condition = (
        f"contains({REFERENCE}, '@') AND NOT starts_with({REFERENCE}, 'docker://') "
        f"AND NOT regexp_matches(string_split({REFERENCE}, '@')[-1], '^[0-9a-f]{{40}}$')"
    )
    return matching(workflows.UNPINNED_ACTION, condition, "is_workflow", lines, trim("line"))


def pwn_request(lines: str) -> str:
    checkout = q(rf"uses:{W}+['\"]?actions/checkout")
    first = f"""(SELECT *, min(CASE WHEN contains(split_part(line, '#', 1), 'pull_request_target') THEN line_no END) OVER (PARTITION BY repo, path) AS first,
      bool_or(regexp_matches(split_part(line, '#', 1), {checkout})) OVER (PARTITION BY repo, path) AS checks_out
      FROM {lines} WHERE is_workflow)"""
    return matching(workflows.PWN_REQUEST, "line_no = first", "checks_out", first, trim("line"))


def rule_sql(rule: Rule, suffix: str) -> str:
    lines, bindings, stages = f"lines{suffix}", f"bindings{suffix}", f"stages{suffix}"
    if rule in SECRET_PATTERNS:
        return secret(rule, lines)
    if rule in CONSTRUCTS:
        return construct(rule, suffix)
    if rule in MATCHING:
        return matching(rule, MATCHING[rule], PLAIN_CODE, lines)
    if rule == CUSTOM_RULE:
        pattern = q(r"(?i)\b(?:fixme|todo)\b|[0-9]{4,}")
        return matching(rule, f"regexp_matches(line, {pattern})", "TRUE", lines)
    special = {
        docker.LATEST_TAG: lambda: latest_tag(lines),
        docker.ROOT_USER: lambda: root_user(stages),
        docker.ENV_SECRET: lambda: env_secret(lines),
        workflows.UNPINNED_ACTION: lambda: unpinned(lines),
        workflows.PWN_REQUEST: lambda: pwn_request(lines),
    }
    return special[rule]()


DEFAULT = [*secrets.SECRET_RULES, *docker.DOCKER_RULES, *code_rules.CODE_RULES, *workflows.WORKFLOW_RULES]


def union(rules, suffix: str) -> str:
    return "\nUNION ALL\n".join(rule_sql(rule, suffix) for rule in rules)


def scan_ctes(suffix: str, source: str, keep: str = SCANNED) -> None:
    CTES[f"routed{suffix}"] = routed(source)
    CTES[f"scanned{suffix}"] = f"SELECT * FROM routed{suffix} WHERE {keep}"
    CTES[f"lines{suffix}"] = lines_of(f"scanned{suffix}")
    CTES[f"bindings{suffix}"] = bindings_of(f"scanned{suffix}")
    CTES[f"stages{suffix}"] = stages_of(f"lines{suffix}")
    CTES[f"directives{suffix}"] = (
        f"SELECT repo, path, line_no, {DIRECTIVE_IDS} AS ids FROM lines{suffix} WHERE {HAS_DIRECTIVE}"
    )


scan_ctes("", "files")
scan_ctes("_c", "corpus")
scan_ctes("_t", "corpus", SCANNED_WITH_TESTS)

CTES["ignore_rules"] = f"""
SELECT repo, CAST(place AS INTEGER) AS place, nullif(tokens[1], '*') AS ignore_path, tokens[2] AS ignore_rule
FROM (SELECT repo, string_split_regex(t, {q(W + "+")}) AS tokens, row_number() OVER (PARTITION BY repo ORDER BY n) - 1 AS place
  FROM (SELECT repo, {trim("l")} AS t, n FROM (SELECT repo, unnest(ls) AS l, generate_subscripts(ls, 1) AS n
    FROM (SELECT repo, string_split_regex(content, '\\r?\\n') AS ls FROM corpus WHERE path = '.scannerignore')))
  WHERE t <> '' AND NOT starts_with(t, '#'))"""

# ---------------------------------------------------------------- dependencies


def dependency_ctes(suffix: str, source: str) -> None:
    CTES[f"locked{suffix}"] = rf"""
SELECT DISTINCT repo, name, version FROM (
  SELECT repo, regexp_extract(key, '(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$', 1) AS name, json_extract_string(max_by(value, rowid), '$.version') AS version
  FROM (SELECT t.repo, e.key, e.value, e.rowid
    FROM (SELECT repo, CASE WHEN json_valid(content) THEN content ELSE '{{}}' END AS content FROM {source} WHERE path = 'package-lock.json') t,
      LATERAL json_each(t.content, '$.packages') e)
  GROUP BY repo, key)
WHERE name <> '' AND version <> ''"""
    CTES[f"declared{suffix}"] = rf"""
SELECT repo, name, min(place) AS place, max_by(specifier, place) AS specifier,
  {trim(f"regexp_replace(max_by(specifier, place), {q('^[~>=<^' + W[1:-1] + ']+')}, '')")} AS version
FROM (SELECT repo, key AS name, specifier, row_number() OVER (PARTITION BY repo ORDER BY part, rowid) AS place FROM (
  SELECT t.repo, p.part, e.key, json_extract_string(e.value, '$') AS specifier, e.rowid
    FROM (SELECT repo, CASE WHEN json_valid(content) THEN content ELSE '{{}}' END AS content FROM {source} WHERE path = 'package.json') t,
      (VALUES (0, 'dependencies'), (1, 'devDependencies')) p(part, name),
      LATERAL json_each(t.content, '$.' || p.name) e))
GROUP BY repo, name"""
    CTES[f"resolved{suffix}"] = f"""
SELECT repo, name, version, 'lock' AS origin FROM locked{suffix}
UNION ALL SELECT repo, name, version, 'manifest' FROM declared{suffix} d
WHERE {CONCRETE} AND NOT EXISTS (SELECT 1 FROM locked{suffix} l WHERE l.repo = d.repo)"""
    CTES[f"matches{suffix}"] = f"""
SELECT d.repo, d.name, d.version, d.origin, a.id, a.summary, a.severity FROM resolved{suffix} d JOIN rated_advisories a ON a.name = d.name
WHERE a.s % 7 = 3 AND d.version = a.version OR CASE a.s % 6 WHEN 0 THEN d.version = a.version WHEN 3 THEN d.version = a.version
  WHEN 1 THEN {version_key("d.version")} < {version_key("((2 + a.p_size % 5) || '.0.0')")}
  WHEN 4 THEN {version_key("d.version")} <= {version_key("a.version")}
  WHEN 5 THEN {version_key("d.version")} >= {version_key("(a.version || '-rc.2')")} AND {version_key("d.version")} < {version_key("(a.version || '-rc.10')")}
  ELSE {version_key("d.version")} >= {version_key("'1.0.0'")} OR ({version_key("d.version")} >= {version_key("'0.0.1'")} AND {version_key("d.version")} < {version_key("'0.9.0-rc.1'")}) END"""
    CTES[f"dependency_found{suffix}"] = f"""
SELECT repo, 'dependency.' || id AS rule_id, 'dependency' AS category, severity, name || '@' || version || ': ' || id AS title,
  'package.json' AS path, CAST(NULL AS INTEGER) AS line, coalesce(substr(summary, 1, 160), id) AS excerpt,
  'Review https://osv.dev/vulnerability/' || id || ' and upgrade ' || name || ' to a patched version.' AS remediation,
  1 AS phase, 0 AS chk, CAST(0 AS BIGINT) AS occ FROM matches{suffix}"""


CONCRETE = r"regexp_matches(version, '^[0-9]+(?:\.[0-9]+){0,2}(?:[-+][0-9A-Za-z.-]+)?$')"


def version_key(v: str) -> str:
    pattern = r"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"

    def part(n: int) -> str:
        return f"CAST(coalesce(nullif(regexp_extract({v}, {q(pattern)}, {n}), ''), '0') AS BIGINT)"

    suffix = f"regexp_extract({v}, {q(pattern)}, 4)"
    released = f"CASE WHEN {suffix} = '' THEN 1 ELSE 0 END"
    digits = "CASE WHEN ltrim(w, '0') = '' THEN '0' ELSE ltrim(w, '0') END"
    word = f"CASE WHEN regexp_full_match(w, '[0-9]+') THEN {{'w': 0, 'n': length({digits}), 't': {digits}}} ELSE {{'w': 1, 'n': 0, 't': w}} END"
    words = f"list_transform(list_filter(string_split(substr({suffix}, 2), '.'), lambda w: w <> ''), lambda w: {word})"
    return f"CASE WHEN regexp_matches({v}, {q(pattern)}) THEN {{'c': [{part(1)}, {part(2)}, {part(3)}, {released}], 'p': {words}}} END"


dependency_ctes("", "corpus")

IS_ENV = (
    "starts_with(b, '.env') AND b <> '.envrc' AND NOT regexp_matches(b, '(?i)\\.(example|sample|template|dist)$')"
)


def env_found(source: str) -> str:
    return f"""
SELECT repo, {q(env_files.RULE_ID)} AS rule_id, 'misconfig' AS category, 'high' AS severity, {q(env_files.TITLE)} AS title, path,
  CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS excerpt, {q(env_files.REMEDIATION)} AS remediation, 2 AS phase, 40 AS chk, CAST(0 AS BIGINT) AS occ
FROM (SELECT *, string_split(path, '/')[-1] AS b FROM {source}) WHERE {IS_ENV}"""


EXTERNAL = """EXISTS (SELECT 1 FROM ignore_rules i WHERE i.repo = f.repo AND (i.ignore_rule IS NULL OR i.ignore_rule = f.rule_id)
  AND (i.ignore_path IS NULL OR f.path = i.ignore_path
    OR starts_with(f.path, CASE WHEN ends_with(i.ignore_path, '/') THEN i.ignore_path ELSE i.ignore_path || '/' END)))"""


def inline(suffix: str) -> str:
    return f"""EXISTS (SELECT 1 FROM directives{suffix} d WHERE d.repo = f.repo AND d.path = f.path
  AND (d.line_no = f.line OR d.line_no = f.line - 1) AND (len(d.ids) = 0 OR list_contains(d.ids, f.rule_id)))"""


def judged(found: str, suffix: str) -> str:
    return f"""
SELECT *, CASE WHEN {EXTERNAL} THEN 'external' WHEN {inline(suffix)} THEN 'inSource' END AS suppression_kind FROM {found} f"""


CTES["line_found"] = union(DEFAULT, "_c")
CTES["env_found"] = env_found("tracked")
CTES["found"] = (
    "SELECT * FROM line_found UNION ALL SELECT * FROM dependency_found UNION ALL SELECT * FROM env_found"
)
CTES["judged"] = judged("found", "_c")
CTES["line_found_t"] = union(DEFAULT, "_t")
CTES["judged_t"] = judged("(SELECT * FROM line_found_t UNION ALL SELECT * FROM env_found)", "_t")

# ---------------------------------------------------------------- snapshots

_others = "(SELECT * FROM ignore_files UNION ALL SELECT * FROM dependency_files)"
CTES["base"] = f"""
SELECT repo, path, content FROM planted WHERE doc_id % 7 <> 0
UNION ALL SELECT repo, 'gone/' || path, content FROM planted WHERE doc_id % 11 = 0 UNION ALL SELECT * FROM {_others}"""
CTES["head"] = f"""
SELECT repo, path, content || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'eval(added);' ELSE '' END AS content FROM planted
UNION ALL SELECT repo, path, content || CASE WHEN path = 'package.json' AND regexp_matches(repo, '[02468]$') THEN chr(10) ELSE '' END FROM {_others}"""
CTES["changed"] = """
SELECT repo, path, CASE WHEN b.content IS NULL THEN 'added' WHEN h.content IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM base b FULL JOIN head h USING (repo, path) WHERE b.content IS DISTINCT FROM h.content"""
CTES["changed_names"] = "SELECT repo, string_split(path, '/')[-1] AS b FROM changed"
CTES["manifest_gate"] = f"SELECT DISTINCT repo FROM changed_names WHERE b IN ({names(MANIFEST_NAMES)})"
CTES["env_gate"] = "SELECT DISTINCT repo FROM changed_names WHERE starts_with(b, '.env')"
CTES["changed_head"] = "SELECT * FROM head SEMI JOIN changed USING (repo, path)"
scan_ctes("_d", "changed_head")
dependency_ctes("_d", "head")
CTES["line_found_d"] = union(DEFAULT, "_d")
CTES["env_found_d"] = env_found("(SELECT * FROM tracked SEMI JOIN env_gate USING (repo))")
CTES["judged_d"] = judged(
    "(SELECT * FROM line_found_d UNION ALL SELECT * FROM dependency_found_d SEMI JOIN manifest_gate USING (repo)"
    " UNION ALL SELECT * FROM env_found_d)",
    "_d",
)

# ---------------------------------------------------------------- reports

RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1"
PUBLIC = "repo, rule_id, category, severity, title, path, line, excerpt, remediation"
LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
ORDER = "suppression_kind IS NOT NULL, phase, path, chk, coalesce(line, 2147483647), occ, rule_id, title"
CTES["hashed"] = f"""
SELECT *, substr(sha256(rule_id || chr(0) || path || chr(0) || regexp_replace({trim("coalesce(excerpt, '')")}, {q(W + "+")}, ' ', 'g')), 1, 16) AS hash FROM judged"""
CTES["printed"] = f"""
SELECT *, CASE WHEN count(*) OVER (PARTITION BY repo, hash) > 1
  THEN hash || ':' || (row_number() OVER (PARTITION BY repo, hash ORDER BY {ORDER}) - 1) ELSE hash END AS fingerprint FROM hashed"""
CTES["first_of_rule"] = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, rule_id ORDER BY {ORDER}) AS r FROM judged) WHERE r = 1"""
SECURITY = "CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '8.0' WHEN 'medium' THEN '5.5' WHEN 'low' THEN '3.0' ELSE '1.0' END"
MESSAGE = "CASE WHEN coalesce(excerpt, '') <> '' THEN title || ': ' || excerpt ELSE title END"
SEVERITIES = ("critical", "high", "medium", "low", "info")
_by_severity = ", ".join(
    f"count(*) FILTER (suppression_kind IS NULL AND severity = '{s}') AS {s}" for s in SEVERITIES
)
_zeros = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("files_scanned", "findings", "suppressed", *SEVERITIES))
CTES["summary"] = f"""
SELECT repo, {_zeros} FROM (SELECT repo, count(*) AS files_scanned FROM scanned_c GROUP BY repo) FULL JOIN
  (SELECT repo, count(*) FILTER (suppression_kind IS NULL) AS findings, count(*) FILTER (suppression_kind IS NOT NULL) AS suppressed, {_by_severity}
   FROM judged GROUP BY repo) USING (repo)"""


def js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def optional(name: str, x: str, value: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE ',\"{name}\":' || {value} END"


_opening = q(
    f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{"name":"{TOOL_NAME}","version":"{__version__}","rules":['
)
COMMA = "CASE WHEN row_number() OVER (PARTITION BY repo ORDER BY {0}) = 1 THEN '' ELSE ',' END"
SARIF = f"""
SELECT repo, CAST(0 AS INTEGER) AS section, {_opening} AS text FROM summary
UNION ALL SELECT repo, 2, ']}}}},"results":[' FROM summary UNION ALL SELECT repo, 4, ']}}]}}' FROM summary
UNION ALL SELECT repo, 1, {COMMA.format(ORDER)} || '{{"id":' || {js("rule_id")} || ',"name":' || {js("rule_id")} || ',"shortDescription":{{"text":' || {js("title")}
  || '}},"fullDescription":{{"text":' || {js("remediation")} || '}},"help":{{"text":' || {js("remediation")} || '}},"defaultConfiguration":{{"level":"' || {LEVEL}
  || '"}},"properties":{{"category":"' || category || '","security-severity":"' || {SECURITY} || '","tags":["security","' || category || '"]}}}}' FROM first_of_rule
UNION ALL SELECT repo, 3, {COMMA.format(ORDER)} || '{{"ruleId":' || {js("rule_id")} || ',"level":"' || {LEVEL} || '","message":{{"text":' || {js(MESSAGE)}
  || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || {js("replace(path, chr(92), '/')")} || '}}' ||
  CASE WHEN line IS NULL THEN '' ELSE ',"region":{{"startLine":' || line || '}}' END || '}}}}],"partialFingerprints":{{"{FINGERPRINT_KEY}":"' || fingerprint || '"}}' ||
  CASE WHEN suppression_kind IS NULL THEN '' ELSE ',"suppressions":[{{"kind":"' || suppression_kind || '","status":"accepted"}}]' END || '}}' FROM printed"""
_item = f"""'{{"ruleId":' || {js("rule_id")} || ',"category":"' || category || '","severity":"' || severity || '","title":' || {js("title")}
  || ',"file":' || {js("path")} || {optional("line", "line", "line")} || {optional("excerpt", "excerpt", js("excerpt"))}
  || ',"remediation":' || {js("remediation")} || {optional("suppressionKind", "suppression_kind", js("suppression_kind"))} || '}}'"""
JSON = f"""
SELECT repo, CAST(0 AS INTEGER) AS section, '{{"root":' || {js("repo")} || ',"filesScanned":' || files_scanned || ',"findings":[' AS text FROM summary
UNION ALL SELECT repo, 2, '],"suppressedFindings":[' FROM summary
UNION ALL SELECT repo, 4, '],"suppressedCount":' || suppressed || '}}' FROM summary
UNION ALL SELECT repo, 1, {COMMA.format(ORDER)} || {_item} FROM judged WHERE suppression_kind IS NULL
UNION ALL SELECT repo, 3, {COMMA.format(ORDER)} || {_item} FROM judged WHERE suppression_kind IS NOT NULL"""
REPORT = f"""
SELECT repo, rule_id, path, line, CAST({RANK} AS INTEGER) AS severity_rank, upper(severity) || ' ' || title || ' [' || rule_id || ']' || chr(10) || '  ' || path ||
  coalesce(':' || line, '') || chr(10) || CASE WHEN coalesce(excerpt, '') <> '' THEN '  ' || excerpt || chr(10) ELSE '' END || '  → ' || remediation AS text
FROM judged WHERE suppression_kind IS NULL"""
_counts = "concat_ws(' · ', " + ", ".join(f"CASE WHEN {s} > 0 THEN {s} || ' {s}' END" for s in SEVERITIES) + ")"
SUMMARY_TEXT = f"""
SELECT repo, concat_ws(chr(10), CASE WHEN findings = 0 THEN 'No issues found.' ELSE findings || ' findings  ' || {_counts} END,
  'Scanned ' || files_scanned || ' files.', CASE WHEN suppressed > 0 THEN suppressed || ' finding(s) suppressed.' END) AS text FROM summary"""


def rules_sql(*rules: Rule) -> str:
    return f"SELECT {PUBLIC} FROM ({union(rules, '')})"


RULE_KEYS = {
    "secret_aws_access_key": [secrets.AWS_ACCESS_KEY],
    "secret_private_key": [secrets.PRIVATE_KEY],
    "secret_api_key": [secrets.API_KEY],
    "secret_jwt_secret": [secrets.JWT_SECRET],
    "secret_bearer_token": [secrets.BEARER_TOKEN],
    "secret_hardcoded_password": [secrets.HARDCODED_PASSWORD],
    "secret_generic_token": [secrets.GENERIC_TOKEN],
    "secret_findings": [*SECRET_PATTERNS],
    "misconfig_eval": [code_rules.EVAL],
    "misconfig_new_function": [code_rules.NEW_FUNCTION],
    "exec_binding_calls": [code_rules.EXEC],
    "misconfig_tls": [code_rules.TLS],
    "misconfig_cors": [code_rules.CORS],
    "misconfig_weak_random": [code_rules.WEAK_RANDOM],
    "misconfig_insecure_http": [code_rules.INSECURE_HTTP],
    "misconfig_findings": code_rules.CODE_RULES,
    "misconfig_eval_fallback": [code_rules.EVAL_FALLBACK],
    "misconfig_new_function_fallback": [code_rules.NEW_FUNCTION_FALLBACK],
    "misconfig_exec_fallback": [code_rules.EXEC_FALLBACK],
    "misconfig_tls_fallback": [code_rules.TLS_FALLBACK],
    "misconfig_cors_fallback": [code_rules.CORS_FALLBACK],
    "misconfig_weak_random_fallback": [code_rules.WEAK_RANDOM_FALLBACK],
    "misconfig_findings_fallback": code_rules.FALLBACK_RULES,
    "docker_latest_tag": [docker.LATEST_TAG],
    "docker_root_user": [docker.ROOT_USER],
    "docker_env_secret": [docker.ENV_SECRET],
    "dockerfile_findings": docker.DOCKER_RULES,
    "gha_unpinned_action": [workflows.UNPINNED_ACTION],
    "gha_pwn_request": [workflows.PWN_REQUEST],
    "gha_findings": workflows.WORKFLOW_RULES,
    "custom_rules": [CUSTOM_RULE],
}

_skipped = f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY place) AS r FROM declared d WHERE NOT coalesce({CONCRETE}, FALSE) AND NOT EXISTS (SELECT 1 FROM locked l WHERE l.repo = d.repo)"
_hit = "SELECT repo, rule_id, path, line, excerpt FROM line_found f WHERE "

FINAL: dict[str, str] = {
    "corpus_files": "SELECT repo, path, strlen(content) AS size, sha256(content) AS digest FROM files",
    "filter_excluded_dirs": f"SELECT repo, path FROM routed WHERE {not_below(DEFAULT_SKIPPED)}",
    "filter_custom_excludes": f"SELECT repo, path FROM routed WHERE {not_below((*DEFAULT_SKIPPED, 'vendor', 'lib'))}",
    "include_test_dirs": f"SELECT repo, path FROM routed WHERE {not_below(ALWAYS_SKIPPED)}",
    "filter_scannable": f"SELECT repo, path FROM routed WHERE {SCANNABLE}",
    "route_file_kind": "SELECT repo, path, is_dockerfile, is_code, is_workflow FROM routed",
    "filter_max_size": f"SELECT repo, path, size FROM routed WHERE size <= {MAX_FILE_BYTES}",
    "explode_lines": "SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, line FROM lines",
    "mask_code_lines": f"SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, {MASKED} AS masked FROM lines WHERE is_code",
    "masked_sources": masked_sql(),
    **{key: rules_sql(*rules) for key, rules in RULE_KEYS.items()},
    "exec_bindings": "SELECT * FROM bindings",
    "docker_stages": "SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, image, CAST(stage AS BIGINT) AS stage, plain AS sets_plain_user FROM stages_c",
    "committed_env_files": f"SELECT {PUBLIC} FROM env_found",
    "untracked_env_files": f"SELECT repo, path FROM (SELECT *, string_split(path, '/')[-1] AS b FROM corpus) WHERE {IS_ENV} AND (repo, path) NOT IN (SELECT (repo, path) FROM tracked)",
    "lock_dependencies": "SELECT repo, name, version, 'lock' AS origin FROM locked",
    "manifest_dependencies": f"SELECT repo, name, version, 'manifest' AS origin FROM declared WHERE {CONCRETE}",
    "manifest_parse_errors": "SELECT repo, path, strlen(content) AS size FROM corpus WHERE path = 'package.json' AND NOT json_valid(content)",
    "skipped_specifier_rows": f"SELECT repo, name, coalesce(specifier, '') AS specifier FROM ({_skipped})",
    "tree_files": "SELECT repo, path, strlen(content) AS size, sha256(content) AS digest FROM corpus",
    "stream_findings": f"SELECT {PUBLIC}, {inline('_c')} AS in_source FROM line_found f WHERE starts_with(repo, 'repo_')",
    "advisory_records": "SELECT repo, name, version, origin, id FROM matches",
    "oversized_files": f"SELECT repo, path, size FROM routed WHERE {SCANNABLE} AND size > {MAX_FILE_BYTES}",
    "skipped_specifiers": f"SELECT repo, count(*) AS skipped, string_agg(name || '@' || coalesce(specifier, ''), ', ' ORDER BY r) FILTER (r <= 5) AS first FROM ({_skipped}) GROUP BY repo",
    "resolved_dependencies": "SELECT * FROM resolved",
    "cvss_base_score": "SELECT key AS p_partkey, vector, base_score FROM part_scores",
    "advisory_severity": "SELECT id, severity FROM rated_advisories",
    "advisory_matches": "SELECT repo, name, version, origin, id FROM matches",
    "dependency_findings": f"SELECT {PUBLIC} FROM dependency_found",
    "dependency_coverage": "SELECT repo, count(*) AS dependencies, count(*) FILTER (name NOT IN (SELECT name FROM advisories)) AS unknown_packages FROM resolved GROUP BY repo",
    "parse_ignore_rules": "SELECT * FROM ignore_rules",
    "inline_directives": "SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, array_to_string(ids, ',') AS rule_ids FROM directives_c",
    "suppress_external": _hit + EXTERNAL,
    "suppress_inline": _hit + inline("_c"),
    "apply_suppressions": f"SELECT {PUBLIC}, suppression_kind FROM ({judged('line_found', '_c')})",
    "apply_suppressions_no_ignore": f"SELECT {PUBLIC}, CAST(NULL AS VARCHAR) AS suppression_kind FROM line_found",
    "suppressed_findings": f"SELECT {PUBLIC}, suppression_kind FROM judged WHERE suppression_kind IS NOT NULL",
    "changed_files": "SELECT * FROM changed",
    "changed_files_by_digest": "SELECT * FROM changed",
    "diff_scan": f"SELECT {PUBLIC}, suppression_kind FROM judged_d",
    "diff_dependency_gate": "SELECT * FROM manifest_gate",
    "diff_env_gate": "SELECT * FROM env_gate",
    "all_findings": f"SELECT {PUBLIC}, suppression_kind FROM judged",
    "scan_texts": f"SELECT {PUBLIC}, CAST(NULL AS VARCHAR) AS suppression_kind FROM ({union([*DEFAULT, secrets.GENERIC_TOKEN], '')}) WHERE NOT starts_with(repo, 'repo_') AND NOT starts_with(repo, 'dep_')",
    "skip_dependencies": f"SELECT {PUBLIC}, suppression_kind FROM judged_t",
    "severity_at_least": f"SELECT {PUBLIC}, suppression_kind FROM judged WHERE {RANK} >= 3",
    "severity_counts": f"SELECT repo, severity, count(*) AS findings, CAST({RANK} AS INTEGER) AS severity_rank FROM judged WHERE suppression_kind IS NULL GROUP BY repo, severity",
    "findings_rollup": "SELECT repo, category, severity, CAST(grouping_id(repo, category, severity) AS INTEGER) AS level, count(*) FILTER (suppression_kind IS NULL) AS findings, count(*) FILTER (suppression_kind IS NOT NULL) AS suppressed FROM judged GROUP BY ROLLUP (repo, category, severity)",
    "scan_summary": "SELECT * FROM summary",
    "scan_totals": "SELECT count(*) AS files_scanned, CAST(sum(size) AS BIGINT) AS bytes_scanned, count_if(is_dockerfile) AS dockerfiles, count_if(is_code) AS code_files, count_if(is_workflow) AS workflows FROM scanned_c",
    "fail_on": "SELECT repo, critical > 0 AS breached FROM summary",
    "finding_fingerprints": "SELECT repo, rule_id, path, line, title, fingerprint FROM printed",
    "sarif_rules": f"SELECT repo, rule_id, title AS short_description, remediation AS full_description, {LEVEL} AS level, category, {SECURITY} AS security_severity FROM first_of_rule",
    "sarif_results": f"SELECT repo, rule_id, {LEVEL} AS level, {MESSAGE} AS message, replace(path, chr(92), '/') AS uri, line AS start_line, fingerprint, suppression_kind FROM printed",
    "sarif_document": SARIF,
    "json_report": JSON,
    "findings_report": REPORT,
    "report_summary": SUMMARY_TEXT,
}


def _needed(sql: str) -> list[str]:
    """The common table expressions a statement builds on, in order."""
    wanted: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"[a-z_]+", pending.pop()))
        for name in CTES:
            if name in words and name not in wanted:
                wanted.add(name)
                pending.append(CTES[name])
    return [name for name in CTES if name in wanted]


def _statement(final: str) -> str:
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in _needed(final))
    return f"WITH {parts}\n{final}" if parts else final


ORACLE_SQL: dict[str, str] = {key: _statement(final) for key, final in FINAL.items()}
