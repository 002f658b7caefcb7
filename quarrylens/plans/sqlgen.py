"""Small helpers that write DuckDB oracle SQL fragments.

These only assemble SQL text for the oracle side (rule CASE chains, split
CTEs); the Spark side never uses them.
"""

from __future__ import annotations

from quarrylens.spec import SchemaSpec


def inv(c: str) -> str:
    """C1 in SQL: null, blank after whitespace strip, or '?'."""
    return (f"(coalesce(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g'), '') "
            f"IN ('', '?'))")


def canon(c: str) -> str:
    """Zero-pad to 2 without truncation."""
    s = f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    return f"(CASE WHEN length({s}) < 2 THEN lpad({s}, 2, '0') ELSE {s} END)"


def bucket(year: str, spec: SchemaSpec) -> str:
    edges, labels = list(spec.bucket_edges), list(spec.bucket_labels)
    parts = " ".join(f"WHEN {year} < {e} THEN '{lab}'" for e, lab in zip(edges, labels[:-1]))
    return f"(CASE {parts} ELSE '{labels[-1]}' END)"


def rule_case(spec: SchemaSpec) -> tuple[str, list[str]]:
    """CASE chain giving the first failing rule (1 = duplicate key)."""
    names = ["drop_duplicate_key"]
    whens = ["WHEN d.copies IS NOT NULL THEN 1"]
    i = 2
    for c in (spec.key, spec.mine_key):
        names.append(f"drop_missing_{c.lower()}")
        whens.append(f"WHEN {inv('r.' + c)} THEN {i}")
        i += 1
    names.append(f"drop_invalid_{spec.target.lower()}")
    whens.append(f"WHEN {inv('r.' + spec.target)} THEN {i}")
    i += 1
    y = f"try_cast(r.{spec.year} AS DOUBLE)"
    names.append(f"drop_calendar_year_before_{spec.min_year}")
    whens.append(f"WHEN {y} IS NULL OR {y} < {spec.min_year} THEN {i}")
    i += 1
    for c in spec.core_features:
        names.append(f"drop_invalid_{c.lower()}")
        whens.append(f"WHEN {inv('r.' + c)} THEN {i}")
        i += 1
    names.append("impute_missing_equipment_as_UNK")
    i += 1
    names.append("drop_missing_narrative")
    whens.append(f"WHEN {inv('r.' + spec.text)} THEN {i}")
    i += 1
    codes = ", ".join(f"'{c}'" for c in spec.excluded_codes)
    names.append(f"drop_excluded_{spec.target.lower()}_for_classifier")
    whens.append(f"WHEN r.{spec.target} IN ({codes}) THEN {i}")
    return "CASE " + " ".join(whens) + " END", names


def tagged_cte(src: str, spec: SchemaSpec, name: str = "tagged") -> str:
    case, _ = rule_case(spec)
    k = spec.key
    return f"""
dups AS (SELECT {k}, count(*) AS copies FROM {src} GROUP BY {k} HAVING count(*) > 1),
{name} AS (SELECT r.*, d.copies, {case} AS rule, {inv('r.' + spec.equipment)} AS equip_bad
  FROM {src} r LEFT JOIN dups d ON r.{k} IS NOT DISTINCT FROM d.{k})"""


def cleaned_cte(src: str, spec: SchemaSpec, name: str = "cleaned") -> str:
    """Kept rows with equipment imputed, year int (other columns as is)."""
    cols_except = f"EXCLUDE ({spec.equipment}, {spec.year}, copies, rule, equip_bad)"
    return tagged_cte(src, spec) + f""",
{name} AS (SELECT * {cols_except},
  CASE WHEN equip_bad THEN 'UNK' ELSE {spec.equipment} END AS {spec.equipment},
  CAST(try_cast({spec.year} AS DOUBLE) AS INTEGER) AS {spec.year}
  FROM tagged WHERE rule IS NULL)"""


def split_cte(src: str, spec: SchemaSpec, seed: int = 42, fraction: float = 0.2,
              name: str = "split") -> str:
    """Exact stratified split as plain window SQL (the oracle form)."""
    k, t, y = spec.key, spec.target, spec.year
    return f"""
sl AS (SELECT *, CAST({t} AS VARCHAR) || '_' || {bucket(y, spec)} AS label FROM {src}),
sc AS (SELECT label, count(*) AS n FROM sl GROUP BY label),
s1 AS (SELECT label, n, CASE WHEN (SELECT min(n) FROM sc) < 2 AND n < 2
          THEN split_part(label, '_', 1) || '_OTHER' ELSE label END AS stratum1 FROM sc),
sn1 AS (SELECT stratum1, sum(n) AS n1 FROM s1 GROUP BY stratum1),
smodal AS (SELECT stratum1 AS modal FROM sn1 ORDER BY n1 DESC, stratum1 LIMIT 1),
smap AS (SELECT s1.label, s1.n, CASE WHEN sn1.n1 < 2 THEN (SELECT modal FROM smodal)
          ELSE s1.stratum1 END AS stratum,
          CASE WHEN sn1.n1 < 2 THEN 2 WHEN s1.stratum1 <> s1.label THEN 1 ELSE 0 END AS stage
          FROM s1 JOIN sn1 USING (stratum1)),
sst AS (SELECT stratum, sum(n) AS n FROM smap GROUP BY stratum),
stot AS (SELECT sum(n) AS total, CAST(ceil({fraction}::DOUBLE * sum(n)) AS BIGINT) AS n_test FROM sst),
sq0 AS (SELECT stratum, n, (n * n_test) // total AS base, (n * n_test) % total AS rem, n_test
        FROM sst, stot),
sq AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, stratum)
          <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM sq0),
sr AS (SELECT sl.*, smap.stratum, row_number() OVER (PARTITION BY smap.stratum
          ORDER BY md5(CAST(sl.{k} AS VARCHAR) || '|{seed}'), sl.{k}) AS rk
       FROM sl JOIN smap USING (label)),
{name} AS (SELECT sr.* EXCLUDE (rk, label), CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split
        FROM sr JOIN sq USING (stratum))"""
