"""Accept the database-request form of a run specification.

Requests written for a database-to-database service describe sources as
``{name, type, connection: {...}, dataset: {schema, table, columns, filters,
batch_size}}`` and the target as ``{type, connection, schema, table,
write_mode, ...}``.  ``normalize_request`` rewrites that form into the flat
form ``parse_spec`` reads (``path`` / ``table`` / ``jdbc``), so such a
request runs unchanged.

Connections: ``jdbc_url`` (+ ``properties``) is used as given;
``sqlalchemy_url`` is rewritten to the JDBC URL of the same database with
user and password as reader properties; ``path`` (+ ``format``) reads files;
no connection means a catalog table ``schema.table``.  Unresolved
``${SECRET:...}`` placeholders are refused: credentials come from the caller
or Spark configuration.
"""
from __future__ import annotations

import re
from urllib.parse import parse_qs, unquote, urlsplit

# Database labels of the request form.
SOURCE_TYPES = ("postgres", "oracle", "sqlserver", "mysql", "generic")

_SECRET = re.compile(r"\$\{SECRET:[^}]*\}")


def jdbc_from_sqlalchemy(url: str) -> tuple[str, dict[str, str]]:
    """``dialect[+driver]://user:pw@host:port/db?...`` -> (JDBC URL, properties)."""
    if _SECRET.search(url):
        raise ValueError("connection URL holds an unresolved ${SECRET:...} placeholder; pass resolved credentials")
    parts = urlsplit(url)
    dialect = parts.scheme.split("+", 1)[0].lower()
    props = {}
    if parts.username:
        props["user"] = unquote(parts.username)
    if parts.password:
        props["password"] = unquote(parts.password)
    host = parts.hostname or "localhost"
    port = f":{parts.port}" if parts.port else ""
    db = parts.path.lstrip("/")
    query = parse_qs(parts.query)
    if dialect in ("postgresql", "postgres"):
        return f"jdbc:postgresql://{host}{port}/{db}", props
    if dialect in ("mysql", "mariadb"):
        return f"jdbc:{dialect}://{host}{port}/{db}", props
    if dialect == "oracle":
        service = query.get("service_name", [db])[0]
        return f"jdbc:oracle:thin:@//{host}{port}/{service}", props
    if dialect == "mssql":
        return f"jdbc:sqlserver://{host}{port};databaseName={db}", props
    if dialect == "sqlite":
        return f"jdbc:sqlite:{parts.path}", props
    raise ValueError(f"no JDBC mapping for connection dialect {dialect!r}; give connection.jdbc_url")


def _connection(conn: dict | None, where: str) -> dict:
    """-> {"jdbc": {...}} or {"path": ...} or {} (catalog table)."""
    if not conn:
        return {}
    extra = set(conn) - {"sqlalchemy_url", "jdbc_url", "properties", "path", "format"}
    if extra:
        raise ValueError(f"{where} connection: unknown fields {sorted(extra)}")
    if "path" in conn:
        return {"path": conn["path"], "format": conn.get("format", "parquet")}
    props = dict(conn.get("properties") or {})
    if "jdbc_url" in conn:
        if _SECRET.search(conn["jdbc_url"]):
            raise ValueError("connection URL holds an unresolved ${SECRET:...} placeholder; pass resolved credentials")
        return {"jdbc": {"url": conn["jdbc_url"], "properties": props}}
    if "sqlalchemy_url" in conn:
        url, auth = jdbc_from_sqlalchemy(conn["sqlalchemy_url"])
        return {"jdbc": {"url": url, "properties": {**auth, **props}}}
    raise ValueError(f"{where} connection needs sqlalchemy_url, jdbc_url or path")


def _qualified(schema: str | None, table: str) -> str:
    return f"{schema}.{table}" if schema else table


# How a database source is split into tasks; bounds may be left to the database.
_SPLIT = ("partition_column", "num_partitions", "lower_bound", "upper_bound")


def _source(s: dict) -> dict:
    if "dataset" not in s:
        return s
    extra = set(s) - {"name", "type", "connection", "dataset"}
    if extra:
        raise ValueError(f"source {s.get('name')!r}: unknown fields {sorted(extra)}")
    if s.get("type") is not None and s["type"] not in SOURCE_TYPES:
        raise ValueError(f"source type must be one of {SOURCE_TYPES}")
    ds = s["dataset"]
    extra = set(ds) - {"schema", "table", "columns", "filters", "batch_size", *_SPLIT}
    if extra:
        raise ValueError(f"source {s.get('name')!r} dataset: unknown fields {sorted(extra)}")
    table = _qualified(ds.get("schema"), ds["table"])
    conn = _connection(s.get("connection"), f"source {s.get('name')!r}")
    out = {"name": s["name"], "columns": ds.get("columns"), "filters": ds.get("filters")}
    if "jdbc" in conn:
        jdbc = {**conn["jdbc"], "table": table}
        if ds.get("batch_size"):
            jdbc["fetch_size"] = int(ds["batch_size"])
        jdbc |= {k: ds[k] for k in _SPLIT if ds.get(k) is not None}
        out["jdbc"] = jdbc
    elif "path" in conn:
        out["path"], out["format"] = conn["path"], conn["format"]
    else:
        out["table"] = table
    return out


def _target(t: dict) -> dict:
    if not any(k in t for k in ("connection", "schema", "type")):
        return t
    t = dict(t)
    typ = t.pop("type", None)
    if typ is not None and typ not in SOURCE_TYPES:
        raise ValueError(f"target type must be one of {SOURCE_TYPES}")
    conn = _connection(t.pop("connection", None), "target")
    table = _qualified(t.pop("schema", None), t.pop("table"))
    if "jdbc" in conn:
        t["jdbc"] = {**conn["jdbc"], "table": table}
    elif "path" in conn:
        t["path"], t["format"] = conn["path"], conn["format"]
    else:
        t["table"] = table
    return t


def normalize_request(d: dict) -> dict:
    """Rewrite a database-request form into the flat spec form (a copy)."""
    out = {k: v for k, v in d.items() if k not in ("audit_message", "node_runId")}
    out["sources"] = [_source(s) for s in d.get("sources") or []]
    if d.get("target") is not None:
        out["target"] = _target(d["target"])
    return out
