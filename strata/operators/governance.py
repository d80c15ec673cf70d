"""Role-based access: column masking (G3), row filters (G4), layer access.

A policy is plain data: role -> rules.  Masking and filtering are column
expressions and a ``where``; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

# Default policy.  Engineers see every layer unmasked; analysts
# see clean and analytics with the SSN masked to its last four digits and the
# e-mail hashed; viewers lose the personal columns; the regional analyst
# sees one region only.
DEFAULT_POLICY = {
    "engineer": {"layers": ["raw", "clean", "analytics"]},
    "analyst": {"layers": ["clean", "analytics"],
                "mask": {"sensitive_ssn": "last4"}, "hash": ["email"]},
    "viewer": {"layers": ["analytics"], "drop": ["sensitive_ssn", "email", "phone"]},
    "analyst_europe": {"layers": ["clean", "analytics"], "mask": {"sensitive_ssn": "last4"},
                       "hash": ["email"], "rows": {"region": ["EUROPE"]}},
}


class AccessDenied(PermissionError):
    pass


def _mask_sql(col: str, how: str) -> str:
    """``last4``: every digit but the last four characters' becomes ``*``, and
    all of them where there are no more than four; ``full``: ``****``."""
    if how == "last4":
        return (f"CASE WHEN length({col}) > 4 THEN concat(regexp_replace(substr({col}, 1, length({col}) - 4), '[0-9]', '*'), substr({col}, -4, 4)) "
                f"ELSE regexp_replace({col}, '.', '*') END")
    if how == "full":
        return f"CASE WHEN {col} IS NOT NULL THEN '****' END"
    raise ValueError(how)


def _mask(col: str, how: str) -> F.Column:
    return F.expr(_mask_sql(f"`{col}`", how))


def apply_policy(df: DataFrame, role: str, policy: dict | None = None, salt: str = "") -> DataFrame:
    """G3 + G4: drop, mask and hash (after ``salt``) columns, then filter rows,
    for ``role``."""
    rules = (policy or DEFAULT_POLICY)[role]
    out = df
    for c, vals in rules.get("rows", {}).items():
        out = out.where(F.col(c).isin(list(vals)))
    drops = [c for c in rules.get("drop", []) if c in out.columns]
    if drops:
        out = out.drop(*drops)
    repl = {c: _mask(c, how) for c, how in rules.get("mask", {}).items() if c in out.columns}
    repl.update({c: F.sha2(F.concat(F.lit(salt), F.col(c)), 256) for c in rules.get("hash", []) if c in out.columns})
    return out.withColumns(repl) if repl else out


def policy_table(spark: SparkSession, policy: dict | None = None) -> DataFrame:
    """The policy as rows (role, layer): which layers a role may read."""
    rows = [(role, layer) for role, rules in (policy or DEFAULT_POLICY).items() for layer in rules.get("layers", [])]
    return spark.createDataFrame(rows, "role string, layer string")


def visible_tables(policy: DataFrame, tables: DataFrame, role: str) -> DataFrame:
    """The tables (table_name, layer, ...) that a role may read."""
    return tables.join(policy.where(F.col("role") == role).select("layer"), "layer", "left_semi")


def visible_layers(role: str, policy: dict | None = None) -> list[str]:
    """The layers a role may read."""
    return list((policy or DEFAULT_POLICY).get(role, {}).get("layers", []))


def read_as(role: str, layer: str, df: DataFrame, policy: dict | None = None) -> DataFrame:
    """Hand out a table of ``layer`` to ``role`` (policy applied), or refuse."""
    if layer not in visible_layers(role, policy):
        raise AccessDenied(f"role {role!r} may not read layer {layer!r}")
    return apply_policy(df, role, policy)


def _quoted(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def view_sql(table: str, columns: list[str], rules: dict, salt: str = "") -> str:
    """What a role sees of a table, as SQL text: G3 and G4 inside the view.

    Columns are found whatever their case, as SQL finds them.  A row filter on
    a column that the table does not have raises: its rows can't be told apart.
    """
    own = lambda key: {c.lower(): c for c in rules.get(key, [])}
    drop, mask, hashed, shown = own("drop"), own("mask"), own("hash"), []
    for c in columns:
        low, q = c.lower(), f"`{c.replace('`', '``')}`"
        if low in drop:
            continue
        if low in hashed:
            shown.append(f"sha2(concat({_quoted(salt)}, {q}), 256) AS {q}")
        elif low in mask:
            shown.append(f"{_mask_sql(q, rules['mask'][mask[low]])} AS {q}")
        else:
            shown.append(q)
    missing = [c for c in rules.get("rows", {}) if c.lower() not in {x.lower() for x in columns}]
    if missing or not shown:
        raise AccessDenied(f"{table}: no column {', '.join(missing)} to filter rows by" if missing else f"{table}: no column is left")
    where = [f"`{c}` IN ({', '.join(map(_quoted, vals))})" for c, vals in rules.get("rows", {}).items()]
    return f"SELECT {', '.join(shown)} FROM {table}" + (f" WHERE {' AND '.join(where)}" if where else "")


def role_views(spark: SparkSession, tables: dict[str, str], database: str, policy: dict | None = None, salt: str = "") -> DataFrame:
    """A database of views per role, ``<database>_<role>``.

    ``tables`` maps catalog tables to their layers.  A role's database has a
    view for each table of its layers, with masks and row filter inside, and
    nothing else: views of tables that the role may no longer read are dropped.
    Who is granted a role's database alone can't pass by the policy with SQL.
    Returns (role, table_name, reason), the reason being null where there is a
    view.
    """
    rows = []
    for role, rules in (policy or DEFAULT_POLICY).items():
        db = f"`{database}_{role}`"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{checkpoint_dir(spark).rstrip('/')}/{database}_{role}.db'")
        views = set()
        for table, layer in tables.items():
            name, reason = table.rsplit(".", 1)[-1], None
            if layer not in rules.get("layers", []):
                reason = f"layer {layer} is not the role's"
            else:
                try:
                    spark.sql(f"CREATE OR REPLACE VIEW {db}.`{name}` AS {view_sql(table, spark.table(table).columns, rules, salt)}")
                    views.add(name)
                except AccessDenied as e:
                    reason = str(e)
            rows.append((role, name, reason))
        for old in spark.sql(f"SHOW VIEWS IN {db}").where("NOT isTemporary").collect():  # a role's views
            if old["viewName"] not in {v.lower() for v in views} | views:
                spark.sql(f"DROP VIEW IF EXISTS {db}.`{old['viewName']}`")
    return spark.createDataFrame(rows, "role string, table_name string, reason string")
