"""TVF01-TVF26: file contents become evidence and dependency rows, by column expressions; trees of settings are walked by a small helper.

For each file kind one expression gives an array of evidence structs (type, value, line) and one an array of dependency
structs (name, version, type, ecosystem); arrays are exploded once, in order of emission. Bad
content gives empty arrays. No pass shuffles, and contents are dropped at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as E
from ..functions import rules
from ..sources import repo
from .ordering import in_walk_order, walk_ranks

EVIDENCE = "array<struct<type:string,value:string,line:int>>"
DEPENDENCY = "array<struct<name:string,version:string,type:string,ecosystem:string>>"


def none(kind: str) -> Column:
    return F.array().cast(kind)


def ev(kind: str, value: Column | str, line: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), (F.lit(value) if isinstance(value, str) else value).alias("value"), (F.lit(None) if line is None else line).cast("int").alias("line"))


def dep(name: Column, version: Column | str, kind: Column | str, ecosystem: str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(name.alias("name"), F.coalesce(lit(version), F.lit("*")).alias("version"), lit(kind).alias("type"), F.lit(ecosystem).alias("ecosystem"))


def found(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def evs(kind: str, values: Column, prefix: str = "") -> Column:
    return F.transform(values, lambda v: ev(kind, F.concat(F.lit(prefix), v) if prefix else v))


def only_if(condition: Column, item: Column) -> Column:
    """The item as an array of one, or an empty array."""
    return F.when(condition, F.array(item)).otherwise(F.array())


def numbered(content: Column) -> Column:
    """Trimmed lines with their numbers."""
    return F.transform(F.split(content, "\n"), lambda x, i: F.struct(E.trim(x).alias("t"), (i + 1).alias("n"), x.alias("raw")))


def nonempty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def is_web(value: Column) -> Column:
    return value.startswith("http://") | value.startswith("https://")


def plain_url(value: Column) -> Column:
    """A web address whose host counts, by the exact list."""
    host = E.host_of(value)
    return is_web(value) & host.isNotNull() & ~E.is_ignored_exact(F.coalesce(host, F.lit("")))


# --- JavaScript, environment, containers, CI ---------------------------------------------------


def _group(content: Column, path: str) -> Column:
    return F.coalesce(F.map_entries(F.from_json(F.get_json_object(content, path), "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def _deps_of(entries: Column, kind: str, ecosystem: str) -> Column:
    return F.transform(entries, lambda e: dep(e["key"], e["value"], kind, ecosystem))


PACKAGE_GROUPS = [("$.dependencies", "production"), ("$.devDependencies", "development"), ("$.peerDependencies", "peer")]


def package_json_deps(c: Column) -> Column:
    return F.concat(*[_deps_of(_group(c, p), k, "npm") for p, k in PACKAGE_GROUPS])


def package_json(c: Column) -> Column:
    return F.concat(*[F.transform(_group(c, p), lambda e: ev("npm_package", e["key"])) for p, _ in PACKAGE_GROUPS])


def env_pairs(content: Column) -> Column:
    """Key, value and line number of each assignment of a dotenv file."""
    lines = F.filter(numbered(content), lambda x: (x["t"] != "") & ~x["t"].startswith("#") & (F.instr(x["t"], "=") > 1))
    at = lambda x: F.instr(x["t"], "=")
    return F.transform(lines, lambda x: F.struct(E.trim(F.substr(x["t"], F.lit(1), at(x) - 1)).alias("key"), E.trim(F.substr(x["t"], at(x) + 1)).alias("value"), x["n"].alias("n")))


def database_of(value: Column) -> Column:
    return F.when(value.startswith("postgres"), "postgresql").when(value.startswith("mysql"), "mysql").when(value.startswith("mongodb"), "mongodb")


def env(c: Column, project: Column) -> Column:
    def of(p: Column) -> Column:
        key, value, n = p["key"], p["value"], p["n"]
        database = database_of(value)
        is_url = (key == "DATABASE_URL") | key.endswith("_DATABASE_URL")
        return F.concat(F.array(ev("env_var", key, n)), only_if(plain_url(value) & ~E.is_own_domain(E.host_of(value), project), ev("url", value, n)), only_if(is_url & database.isNotNull(), ev("domain", database, n)))

    return F.flatten(F.transform(env_pairs(c), of))


def env_map(content: Column) -> Column:
    """TVF26: the last value of each key, without quotes around it."""

    def last(sorted_pairs: Column) -> Column:
        after = lambda i: F.get(sorted_pairs, i + 1)["key"]
        return F.filter(sorted_pairs, lambda p, i: ~p["key"].eqNullSafe(after(i)))

    in_order = F.array_sort(F.transform(env_pairs(content), lambda p: F.struct(p["key"].alias("key"), p["n"].alias("n"), p["value"].alias("value"))))
    return F.map_from_entries(F.transform(E.bound(in_order, last), lambda p: F.struct(p["key"].alias("key"), F.regexp_replace(p["value"], r"""^["']|["']\z""", "").alias("value"))))


def compose(c: Column) -> Column:
    images = F.transform(found(c, r"""image:\s*['"]?([^\s'"#]+)"""), lambda x: F.split_part(x, F.lit(":"), F.lit(1)))
    block = F.regexp_extract(c, r"(?m)^services:\s*\n((?:[ \t].*\n?)*)", 1)
    return F.concat(evs("domain", images), evs("config_file", found(block, r"(?m)^\s{2}(\w[\w-]*):"), "docker-service:"))


def workflow(c: Column) -> Column:
    actions = F.filter(found(c, r"""uses:\s*['"]?([^@\s'"]+)"""), lambda a: a.contains("/"))
    secrets = F.concat(found(c, r"\$\{\{\s*secrets\.(\w+)\s*\}\}"), found(c, r"\$([A-Z][A-Z_]*_[A-Z_]{2,})"))
    return F.concat(F.array(ev("config_file", "github-actions")), evs("ci_secret", secrets), evs("config_file", actions, "action:"))


# --- source code -----------------------------------------------------------------------------

_Q, _URL = r"[`'\"]", r"(https?://[^`'\"]+)"
# Calls that make an address a service, in order; the first that matches a line decides.
API_CALLS = [
    rf"fetch\s*\(\s*{_Q}{_URL}{_Q}",
    rf"fetch\s*\(\s*`[^`]*\$\{{[^}}]+\}}[^`]*{_URL}`",
    rf"axios\s*\.\s*(?:get|post|put|patch|delete|request|head|options)\s*\(\s*{_Q}{_URL}{_Q}",
    rf"axios\s*\(\s*\{{[^}}]*url\s*:\s*{_Q}{_URL}{_Q}",
    rf"new\s+URL\s*\(\s*{_Q}{_URL}{_Q}",
    rf"baseURL\s*:\s*{_Q}{_URL}{_Q}",
    rf"baseUrl\s*:\s*{_Q}{_URL}{_Q}",
    rf"\burl\s*:\s*{_Q}{_URL}{_Q}",
    rf"\bendpoint\s*:\s*{_Q}{_URL}{_Q}",
    rf"\.get\s*\(\s*{_Q}{_URL}{_Q}",
    rf"\.post\s*\(\s*{_Q}{_URL}{_Q}",
    rf"\.put\s*\(\s*{_Q}{_URL}{_Q}",
    rf"\.delete\s*\(\s*{_Q}{_URL}{_Q}",
    rf"\.patch\s*\(\s*{_Q}{_URL}{_Q}",
    rf"\.open\s*\(\s*['\"][A-Z]+['\"]\s*,\s*{_Q}{_URL}{_Q}",
    rf"(?:const|let|var|=)\s*\w*(?:URL|Url|url|ENDPOINT|endpoint|BASE|base|API|api|HOST|host)\w*\s*=\s*{_Q}{_URL}{_Q}",
]
CONTENT_LINE = r"href\s*=\s*[`'\"]|src\s*=\s*[`'\"]|action\s*=\s*[`'\"]|^\s*//|^\s*\*|^\s*\{?\s*/\*"
ENV_REFERENCE = r"process\.env\.([A-Z_]*(?:URL|HOST|ENDPOINT|DSN|KEY|SECRET|TOKEN|BEARER|API_KEY|CREDENTIALS)[A-Z_]*)"
IMPORT_FROM = r"""from\s+['"]([^./][^'"]+)['"]"""
REQUIRE = r"""require\(\s*['"]([^./][^'"]+)['"]\s*\)"""


def is_content_line(line: Column) -> Column:
    """TVF07."""
    return line.rlike(CONTENT_LINE)


def api_url(line: Column) -> Column:
    """TVF06: the address of the first matching call pattern; null if none matches."""
    first = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in API_CALLS])
    return F.regexp_replace(first, r"[),;'\"}\]]+\z", "")


def source(c: Column, project: Column) -> Column:
    def calls(url: Column, n: Column) -> Column:
        counts = lambda host: F.coalesce(host.isNotNull() & ~E.is_ignored_suffix(host) & ~E.is_own_domain(host, project), F.lit(False))
        return E.bound(E.host_of(url), lambda host: F.when(counts(host), F.array(ev("url", url, n), ev("domain", host, n))).otherwise(none(EVIDENCE)))

    def of(x: Column) -> Column:
        line, n = x["raw"], x["n"]
        called = F.when(line.rlike("https?://"), E.bound(api_url(line), lambda url: calls(url, n))).otherwise(none(EVIDENCE))
        references = F.transform(found(line, ENV_REFERENCE), lambda v: ev("env_var", v, n))
        seen = F.when(is_content_line(line), none(EVIDENCE)).otherwise(F.concat(called, references))
        imports = F.transform(F.concat(found(line, IMPORT_FROM), found(line, REQUIRE)), lambda v: ev("import", v, n))
        return F.concat(seen, imports)

    lines = F.transform(F.split(c, "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("raw")))
    worth = F.filter(lines, lambda x: x["raw"].rlike(r"https?://|process\.env\.|from\s|require\("))
    return F.flatten(F.transform(worth, of))


# --- Python, Rust, Go, Terraform ----------------------------------------------------------------


def _names(block: Column, quoted: str) -> Column:
    """Names of quoted requirement strings."""
    entries = F.transform(found(block, quoted, 0), lambda x: F.regexp_extract(F.regexp_replace(x, "[\"']", ""), r"^([a-zA-Z0-9_.-]+)", 1))
    return F.transform(nonempty(entries), lambda n: dep(n, "*", "production", "pip"))


def requirements(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: E.trim(x)), lambda x: (x != "") & ~x.rlike("^[#-]") & x.rlike("^[a-zA-Z0-9_.-]"))
    shape = r"^([a-zA-Z0-9_.-]+)\s*(?:[><=!~]+\s*(.+))?"
    return F.transform(lines, lambda x: dep(F.regexp_extract(x, shape, 1), F.nullif(F.regexp_extract(x, shape, 2), F.lit("")), "production", "pip"))


def pyproject(c: Column) -> Column:
    return _names(F.regexp_extract(c, r"(?s)\[project\].*?dependencies\s*=\s*\[(.*?)\]", 1), r""""[^"]+"|'[^']+'""")


def setup_py(c: Column) -> Column:
    return _names(F.regexp_extract(c, r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), r"""'[^']+'|"[^"]+\"""")


def cargo(c: Column) -> Column:
    line = r"""(?m)^[a-zA-Z0-9_-]+\s*=\s*(?:"[^"]+"|\{.*?version\s*=\s*"[^"]+".*\})"""

    def of(section: str, kind: str) -> Column:
        blocks = found(c, rf"(?s)\[{section}\](.*?)(?=\n\[|\z)")
        rows = F.flatten(F.transform(blocks, lambda b: found(b, line, 0)))
        version = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"""^[a-zA-Z0-9_-]+\s*=\s*"([^"]+)\"""", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"""version\s*=\s*"([^"]+)\"""", 1), F.lit("")))
        return F.transform(rows, lambda x: dep(F.regexp_extract(x, "^([a-zA-Z0-9_-]+)", 1), version(x), kind, "cargo"))

    return F.concat(of("dependencies", "production"), of("dev-dependencies", "development"), of("build-dependencies", "development"))


def go_mod(c: Column) -> Column:
    module = r"^(\S+)\s+(v[\d.]+\S*)"
    inner = F.flatten(F.transform(found(c, r"(?s)require\s*\((.*?)\)"), lambda b: F.split(b, "\n")))
    listed = F.filter(F.transform(inner, lambda x: E.trim(x)), lambda x: x.rlike(module))
    single = F.transform(found(c, r"(?m)^require\s+\S+\s+v[\d.]+\S*", 0), lambda x: F.regexp_replace(x, r"^require\s+", ""))
    return F.transform(F.concat(listed, single), lambda x: dep(F.regexp_extract(x, module, 1), F.regexp_extract(x, module, 2), "production", "go"))


def terraform(c: Column) -> Column:
    # Providers that are no services.
    real = lambda names: F.filter(names, lambda n: ~n.isin("random", "null", "local", "template"))
    names = F.concat(real(found(c, r'provider\s+"([^"]+)"')), found(c, r'(\w+)\s*=\s*\{[^}]*source\s*=\s*"[^"]+"'), real(found(c, r'resource\s+"(\w+?)_')))
    return evs("config_file", names, "terraform:")


# --- .NET --------------------------------------------------------------------------------------


def csproj_deps(c: Column) -> Column:
    def of(tag: str, kind: str) -> Column:
        shape = rf'(?i)<{tag}\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?'
        has = rf'(?i)<{tag}\s+Include="[^"]+"\s+Version="'
        return F.transform(found(c, shape, 0), lambda x: dep(F.regexp_extract(x, shape, 1), F.when(x.rlike(has), F.regexp_extract(x, shape, 2)), kind, "nuget"))

    return F.concat(of("PackageReference", "production"), of("DotNetCliToolReference", "development"))


def csproj(c: Column) -> Column:
    return evs("import", found(c, r'(?i)<PackageReference\s+Include="([^"]+)"'))


def connection(value: Column) -> Column:
    return F.when(value.rlike("(?i)Server=|Data Source="), "sqlserver").when(value.startswith("mongodb"), "mongodb").when(value.startswith("postgres"), "postgresql")


def settings_leaves(files: DataFrame) -> DataFrame:
    """TVF15: prefix, key and value of every string in a settings file; arrays add nothing to the prefix.

    One pass over the files, whose texts are read and written anew as JSON before, so that a helper sees good ones alone; it keeps one file's tree.
    """
    import json

    import pyarrow as pa

    schema = T.StructType([*[files.schema[c] for c in ("repo_id", "file", "ord0")], *[T.StructField(c, T.StringType()) for c in ("prefix", "key", "value")]])
    rows = files.select("repo_id", "file", "ord0", F.to_json(F.try_parse_json("content")).alias("json")).where("json IS NOT NULL")

    def leaves(text: str):
        todo = [("", None, json.loads(text))]
        while todo:
            prefix, key, value = todo.pop()
            if isinstance(value, str):
                if key is not None and value:
                    yield prefix, key, value
                continue
            below = prefix if key is None else f"{prefix}:{key}" if prefix else key
            children = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
            todo.extend((below, k, v) for k, v in children if isinstance(v, str | dict | list))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                got = [(i, *leaf) for i, text in enumerate(some.column(3).to_pylist()) for leaf in leaves(text)]
                index, *columns = zip(*got, strict=True) if got else ((), (), (), ())
                own = [some.column(c).take(pa.array(index, pa.int64())) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, pa.string()) for c in columns]], names=schema.names)

    return rows.mapInArrow(run, schema)


def settings_evidence(prefix: Column, key: Column, value: Column) -> Column:
    """TVF15: what one string of a settings file is evidence of."""
    linked = prefix.rlike("(?i)^connectionstrings?") | key.rlike("(?i)^connectionstrings?")
    database = F.coalesce(connection(value), F.when(value.startswith("mysql"), "mysql").when(value.startswith("redis"), "redis").when(value.rlike("(?i)amqp://"), "rabbitmq"))
    upper = lambda x: F.upper(F.regexp_replace(x, ":", "_"))
    whole = F.when(prefix == "", key).otherwise(F.concat_ws(":", prefix, key))
    secret = key.rlike(r"(?i)(KEY|SECRET|TOKEN|DSN)\z") & (F.length(value) > 5)
    named = key.rlike(r"(?i)^(ApiKey|SecretKey|AccessKey|ConnectionString)\z") & (prefix != "")
    return F.concat(only_if(linked & database.isNotNull(), ev("domain", database)), only_if(plain_url(value), ev("url", value)), only_if(secret, ev("env_var", upper(whole))), only_if(named, ev("env_var", F.concat_ws("_", upper(prefix), F.upper(key)))))


def web_config(c: Column) -> Column:
    strings = F.transform(found(c, r'(?i)connectionString="([^"]+)"'), connection)
    shape = r'(?i)<add\s+key="([^"]+)"\s+value="([^"]*)"\s*/>'

    def of(x: Column) -> Column:
        key, value = F.regexp_extract(x, shape, 1), F.regexp_extract(x, shape, 2)
        return F.concat(only_if(key.rlike(r"(?i)(_KEY|_SECRET|_TOKEN|_URL|_DSN)\z"), ev("env_var", key)), only_if(plain_url(value), ev("url", value)))

    return F.concat(evs("domain", F.filter(strings, lambda s: s.isNotNull())), F.flatten(F.transform(found(c, shape, 0), of)))


# --- Java --------------------------------------------------------------------------------------


def _maven(c: Column) -> Column:
    tag = lambda b, name: F.nullif(F.regexp_extract(b, f"<{name}>([^<]+)</{name}>", 1), F.lit(""))
    blocks = F.transform(found(c, r"(?is)<dependency>\s*(.*?)</dependency>"), lambda b: F.struct(tag(b, "groupId").alias("g"), tag(b, "artifactId").alias("a"), tag(b, "version").alias("v"), tag(b, "scope").alias("s")))
    return F.filter(blocks, lambda b: b["a"].isNotNull())


def pom_deps(c: Column) -> Column:
    return F.transform(_maven(c), lambda b: dep(F.concat_ws(":", b["g"], b["a"]), b["v"], F.when(b["s"] == "test", "development").otherwise("production"), "maven"))


def pom(c: Column) -> Column:
    return F.transform(_maven(c), lambda b: ev("import", b["a"]))


def _gradle(c: Column) -> Column:
    shape = r"""(?i)(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|kapt|annotationProcessor)\s*[\("']([^)"']+)[\)"']"""
    rows = F.transform(found(c, shape, 0), lambda x: F.struct(F.split(F.regexp_extract(x, shape, 2), ":").alias("p"), x.rlike("(?i)^test").alias("test")))
    return F.filter(rows, lambda r: F.size(r["p"]) >= 2)


def gradle_deps(c: Column) -> Column:
    part = lambda r, i: F.get(r["p"], F.lit(i))
    return F.transform(_gradle(c), lambda r: dep(F.concat(part(r, 0), F.lit(":"), part(r, 1)), part(r, 2), F.when(r["test"], "development").otherwise("production"), "gradle"))


def gradle(c: Column) -> Column:
    return F.transform(_gradle(c), lambda r: ev("import", F.get(r["p"], F.lit(1))))


def properties(c: Column) -> Column:
    def of(p: Column) -> Column:
        key, value = p["key"], p["value"]
        has = lambda *names: reduce(lambda a, b: a | b, [key.contains(n) for n in names])
        database = F.when(value.contains("postgres"), "postgresql").when(value.contains("mysql"), "mysql").when(value.contains("mongodb"), "mongodb").when(value.contains("sqlserver") | value.contains("mssql"), "sqlserver")
        parts = F.split(key, r"\.")
        service = F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
        secret = key.rlike(r"(?i)\.(api-key|api_key|secret|token|key)\z") & (F.length(service) >= 2)
        return F.concat(
            only_if(has("datasource.url", "database.url") & database.isNotNull(), ev("domain", database)), only_if(has("redis.host", "redis.url"), ev("domain", "redis")),
            only_if(has("rabbitmq.host", "amqp"), ev("domain", "rabbitmq")), only_if(has("kafka.bootstrap"), ev("env_var", "KAFKA_BOOTSTRAP_SERVERS")),
            only_if(has("mongodb.uri", "mongo.uri"), ev("domain", "mongodb")), only_if(secret, ev("env_var", F.concat(F.upper(service), F.lit("_KEY")))),
            only_if(plain_url(value), ev("url", value)),
        )

    return F.flatten(F.transform(env_pairs(c), of))


def application_yml(c: Column) -> Column:
    def of(x: Column) -> Column:
        t = x["t"]
        jdbc = F.when(t.rlike("(?i)url:\\s*jdbc:(postgresql|mysql|sqlserver|oracle|mariadb)"), F.lower(F.regexp_extract(t, r"(?i)jdbc:(\w+)", 1)))
        database = F.when(jdbc.isin("postgresql", "postgres"), "postgresql").when(jdbc.isin("mysql", "mariadb"), "mysql").when(jdbc == "sqlserver", "sqlserver")
        url = F.regexp_extract(t, r"(?i):\s*(https?://\S+)", 1)
        return F.concat(
            only_if(database.isNotNull(), ev("domain", database)), only_if(t.rlike(r"redis:\s*\z") | (t.rlike(r"host:\s*\S+") & x["raw"].contains("redis")), ev("domain", "redis")),
            only_if(t.rlike(r"(?i)mongodb(\+srv)?://"), ev("domain", "mongodb")), only_if(t.rlike("(?i)rabbitmq:"), ev("domain", "rabbitmq")),
            only_if(t.rlike("(?i)kafka:") & t.rlike("(?i)bootstrap"), ev("env_var", "KAFKA_BOOTSTRAP_SERVERS")), only_if(plain_url(url), ev("url", url)),
        )

    return F.flatten(F.transform(F.filter(numbered(c), lambda x: (x["t"] != "") & ~x["t"].startswith("#")), of))


# --- Ruby, PHP, more Python ----------------------------------------------------------------------

# The first group is the line where a match starts; only that line is searched for an inline group.
_GEM = r"""(?m)^(?=([^\n]*))\s*gem\s+['"]([^'"]+)['"]\s*(?:,\s*['"]([^'"]*)['"]\s*)?(?:,\s*['"]([^'"]*)['"]\s*)?"""
_INNER_GEM = r"""gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]*)['"]\s*)?"""


def _gems(c: Column) -> Column:
    """Gems of the main pass, then those of group blocks that are new."""
    group = r"(?i)group:\s*(?::development|:test|\[:development|:dev)"
    rows = F.arrays_zip(found(c, _GEM, 1).alias("l"), found(c, _GEM, 2).alias("n"), found(c, _GEM, 3).alias("v"))
    main = F.transform(rows, lambda r: F.struct(r["n"].alias("n"), F.nullif(r["v"], F.lit("")).alias("v"), r["l"].rlike(group).alias("dev")))
    known = F.transform(main, lambda g: g["n"])
    blocks = F.flatten(F.transform(found(c, r"(?is)group\s+(?::development|:test)\s+do\s*(.*?)end"), lambda b: found(b, _INNER_GEM, 0)))
    inner = F.transform(blocks, lambda x: F.struct(F.regexp_extract(x, _INNER_GEM, 1).alias("n"), F.nullif(F.regexp_extract(x, _INNER_GEM, 2), F.lit("")).alias("v"), F.lit(True).alias("dev")))
    return F.concat(main, F.array_distinct(F.filter(inner, lambda g: ~F.array_contains(known, g["n"]))))


def gemfile_deps(c: Column) -> Column:
    return F.transform(_gems(c), lambda g: dep(g["n"], g["v"], F.when(g["dev"], "development").otherwise("production"), "gem"))


def gemfile(c: Column) -> Column:
    return F.transform(_gems(c), lambda g: ev("import", g["n"]))


def database_yml(c: Column) -> Column:
    adapters = F.transform(found(c, r"""(?i)adapter:\s*['"]?(\w+)['"]?"""), lambda a: F.lower(a))
    by_adapter = F.transform(adapters, lambda a: F.when(a.isin("postgresql", "postgres"), "postgresql").when(a.isin("mysql2", "mysql"), "mysql").when(a.isin("mongodb", "mongoid"), "mongodb"))
    by_url = F.transform(found(c, r"""(?i)url:\s*['"]?((?:postgres|mysql|mongodb)\w*://[^\s'"]+)"""), database_of)
    return F.concat(evs("domain", F.filter(F.concat(by_adapter, by_url), lambda x: x.isNotNull())), only_if(c.rlike("(?i)redis://"), ev("domain", "redis")))


COMPOSER_GROUPS = [("$.require", "production"), ("$['require-dev']", "development")]


def _composer(c: Column, path: str) -> Column:
    return F.filter(_group(c, path), lambda e: (e["key"] != "php") & ~e["key"].startswith("ext-"))


def composer_deps(c: Column) -> Column:
    return F.concat(*[_deps_of(_composer(c, p), k, "composer") for p, k in COMPOSER_GROUPS])


def composer(c: Column) -> Column:
    short = lambda n: F.when(n.contains("/"), F.split_part(n, F.lit("/"), F.lit(2))).otherwise(n)
    return F.flatten(F.concat(*[F.transform(_composer(c, p), lambda e: F.array(ev("import", short(e["key"])), ev("import", e["key"]))) for p, _ in COMPOSER_GROUPS]))


def pipfile(c: Column) -> Column:
    """TVF24: each line belongs to the last section header before it."""
    lines = F.transform(F.split(c, "\n"), lambda x: E.trim(x))
    state = F.aggregate(
        lines, F.struct(F.lit("").alias("s"), F.array().cast("array<struct<s:string,n:string>>").alias("a")),
        lambda acc, x: F.when(x.startswith("["), F.struct(F.when(x.isin("[packages]", "[dev-packages]"), x).otherwise("").alias("s"), acc["a"].alias("a")))
        .when((acc["s"] != "") & (x != "") & ~x.startswith("#") & x.rlike(r"^[a-zA-Z0-9_.-]+\s*="), F.struct(acc["s"].alias("s"), F.array_append(acc["a"], F.struct(acc["s"].alias("s"), F.regexp_extract(x, "^([a-zA-Z0-9_.-]+)", 1).alias("n"))).alias("a")))
        .otherwise(acc),
    )
    return F.transform(state["a"], lambda r: dep(r["n"], "*", F.when(r["s"] == "[dev-packages]", "development").otherwise("production"), "pip"))


def setup_cfg(c: Column) -> Column:
    block = F.regexp_extract(c, r"(?s)install_requires\s*=\s*(.*?)(?=\n\[|\n\S+\s*=|\z)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: E.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.transform(nonempty(F.transform(lines, lambda x: F.regexp_extract(x, "^([a-zA-Z0-9_.-]+)", 1))), lambda n: dep(n, "*", "production", "pip"))


#: File kind -> evidence; two of them compare hosts with the repository's own.
EVIDENCE_OF: dict[str, Callable[..., Column]] = {
    "package_json": package_json, "env": env, "compose": compose, "workflow": workflow, "terraform": terraform, "csproj": csproj, "web_config": web_config,
    "pom": pom, "gradle": gradle, "properties": properties, "application_yml": application_yml, "gemfile": gemfile, "database_yml": database_yml,
    "composer": composer, "source": source,
}
#: File kind -> dependencies; pip, cargo and go give no evidence by themselves.
DEPENDENCIES_OF: dict[str, Callable[[Column], Column]] = {
    "package_json": package_json_deps, "requirements": requirements, "pyproject": pyproject, "setup_py": setup_py, "cargo": cargo, "go_mod": go_mod,
    "csproj": csproj_deps, "pom": pom_deps, "gradle": gradle_deps, "gemfile": gemfile_deps, "composer": composer_deps, "pipfile": pipfile, "setup_cfg": setup_cfg,
}


def kinds(files: DataFrame) -> DataFrame:
    """Walked files with their kind; files that nothing parses go."""
    named = files if "ext" in files.columns else repo.with_names(files)
    return named.withColumn("kind", repo.file_kind(F.col("path"), F.col("basename"), F.col("ext"))).where("kind IS NOT NULL")


def _chain(made: dict[str, Column]) -> Column:
    """The column of a row's kind; null for others."""
    out = None
    for kind, column in made.items():
        out = F.when(F.col("kind") == kind, column) if out is None else out.when(F.col("kind") == kind, column)
    return out


def evidence_of(files: DataFrame, project: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """repo_id, type, value, file, line, at (place in the file) of all evidence; of the kinds in only, if given, and the plan holds their parsers alone."""
    c, own = F.col("content"), F.lit(None).cast("string") if project is None else project
    wanted = [k for k in ("config_name", *EVIDENCE_OF) if only is None or k in only]
    rows = kinds(files).where(F.col("kind").isin([*wanted, *(["appsettings"] if only is None or "appsettings" in only else [])]))
    chain = _chain({k: F.array(ev("config_file", F.col("basename"))) if k == "config_name" else (EVIDENCE_OF[k](c, own) if EVIDENCE_OF[k] in (env, source) else EVIDENCE_OF[k](c)).cast(EVIDENCE) for k in wanted})
    parts = []
    if wanted:
        parts.append(rows.where("kind <> 'appsettings'").select("repo_id", F.col("path").alias("file"), F.posexplode(chain).alias("at", "e")))
    if only is None or "appsettings" in only:
        settings = settings_leaves(rows.where("kind = 'appsettings'").select("repo_id", F.col("path").alias("file"), F.lit(0).cast("long").alias("ord0"), "content"))
        parts.append(settings.select("repo_id", "file", "ord0", F.posexplode(settings_evidence(F.col("prefix"), F.col("key"), F.col("value")).cast(EVIDENCE)).alias("at", "e")).select("repo_id", "file", (F.col("ord0") + F.col("at")).cast("int").alias("at"), "e"))
    if not parts:
        parts = [rows.limit(0).select("repo_id", F.col("path").alias("file"), F.lit(0).alias("at"), F.lit(None).cast(EVIDENCE)[0].alias("e"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("repo_id", "e.type", "e.value", "file", "e.line", "at")


def dependencies_of(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """repo_id, name, version, type, ecosystem, file, at (place in the file) of all manifests' entries."""
    wanted = [k for k in DEPENDENCIES_OF if only is None or k in only]
    rows = kinds(files).where(F.col("kind").isin(wanted))
    chain = _chain({k: DEPENDENCIES_OF[k](F.col("content")).cast(DEPENDENCY) for k in wanted}) if wanted else F.array().cast(DEPENDENCY)
    return rows.select("repo_id", F.col("path").alias("file"), F.posexplode(chain).alias("at", "d")).select("repo_id", "d.*", "file", "at")


def extract_evidences(files: DataFrame, project: Column | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """repo_id, type, value, file, line, ord of all evidence; ord follows the walk, and emission within a file."""
    return in_walk_order(evidence_of(files, project), walk_ranks(files) if ranks is None else ranks)


def extract_dependencies(files: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """repo_id, name, version, type, ecosystem, file, ord of all manifests' entries."""
    return in_walk_order(dependencies_of(files), walk_ranks(files) if ranks is None else ranks)


def ecosystems(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """FN07: repo_id, ecosystems (sorted, distinct), by dependencies and by file names."""
    by_file = repo.with_names(files).select("repo_id", E.ecosystem_of_file(F.col("basename"), F.col("ext")).alias("e"))
    by_dep = dependencies.select("repo_id", E.ecosystem_of(F.col("ecosystem")).alias("e"))
    return by_file.union(by_dep).where("e IS NOT NULL").groupBy("repo_id").agg(F.array_sort(F.collect_set("e")).alias("ecosystems"))


# --- the project's own names ---------------------------------------------------------------------

# Files and variables that tell a project's own domain, in order.
OWN_DOMAIN_FILES = [".env", ".env.local", ".env.production", ".env.example"]
OWN_DOMAIN_VARIABLES = ["NEXT_PUBLIC_URL", "NEXT_PUBLIC_SITE_URL", "NEXT_PUBLIC_APP_URL", "PUBLIC_URL", "APP_URL", "SITE_URL", "VERCEL_URL"]


def project_names(files: DataFrame, config_name: str = "stack.config.json") -> DataFrame:
    """FN05/FN06: repo_id, own_domain (null if unknown), project_name (null without a name: the folder's name counts then)."""
    root = files.where(~F.col("path").contains("/"))
    c = F.col("content")

    def known(place: Column, value: Column) -> Column:
        """The value and its place in the order; null without a value."""
        return E.bound(value, lambda v: F.when(v.isNotNull(), F.struct(place.cast("int").alias("p"), v.alias("v"))))

    def of_env(which: Column) -> Column:
        variables = F.array(*[F.lit(v) for v in OWN_DOMAIN_VARIABLES])
        told = lambda values: F.transform(variables, lambda v, j: E.bound(F.nullif(F.element_at(values, v), F.lit("")), lambda x: known(which * 100 + j, E.apex(x))))
        return F.get(F.filter(E.bound(env_map(c), told), lambda x: x.isNotNull()), F.lit(0))

    which = F.array_position(F.array(*[F.lit(f) for f in OWN_DOMAIN_FILES]), F.col("path"))
    alias = E.apex(F.nullif(F.get_json_object(c, "$.alias[0]"), F.lit("")))
    package = F.nullif(F.get_json_object(c, "$.name"), F.lit(""))
    chosen = F.nullif(F.get_json_object(c, "$.project.name"), F.lit(""))
    rows = root.select(
        "repo_id",
        F.when(which > 0, of_env(which)).when(F.col("path") == "vercel.json", known(F.lit(1000), alias)).when(F.col("path") == "package.json", known(F.lit(2000), E.project_label(package))).alias("d"),
        F.when(F.col("path") == config_name, known(F.lit(0), chosen)).when(F.col("path") == "package.json", E.bound(package, lambda x: known(F.lit(1), E.format_project_name(x)))).alias("n"),
    )
    return rows.groupBy("repo_id").agg(F.min("d")["v"].alias("own_domain"), F.min("n")["v"].alias("project_name"))
