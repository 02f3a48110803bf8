"""Sources: repository files as rows, and what a walk would have kept of them (SRC01-SRC06, SRC15-SRC17).

A files table has repo_id, path (relative, with /), content (null if unreadable) and size; reading one
folder of repositories and reading a stored table give the same columns.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules


def read_repositories(spark: SparkSession, root: str) -> DataFrame:
    """SRC01/SRC03: every file below root/<repo_id>/; the size bound is pushed into the file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= rules.MAX_FILE_BYTES)
    tail = F.regexp_replace(F.col("path"), "^.*?" + re.escape("/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"), "")
    return files.select(F.split_part(tail, F.lit("/"), F.lit(1)).alias("repo_id"), F.regexp_replace(tail, "^[^/]*/", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def with_names(files: DataFrame) -> DataFrame:
    """Adds basename and ext (from the last dot, unless it comes first)."""
    base = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("basename", base).withColumn("ext", F.regexp_extract("basename", r"^.+(\.[^.]*)\z", 1))


def ignore_patterns(content: str) -> list[tuple[bool, bool, str]]:
    """SRC02: (negated, folders only, regex of a whole relative path) for each pattern of a root ignore file; later ones win."""
    found = []
    for line in content.split("\n"):
        pattern = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r"))
        if not pattern or pattern.startswith("#"):
            continue
        negated = pattern.startswith("!")
        pattern = pattern[1:] if negated else pattern
        anchored = "/" in pattern.rstrip("/")
        only_dirs = pattern.endswith("/")
        body, i, text = "", 0, pattern.strip("/")
        while i < len(text):
            if text.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif text.startswith("**", i):
                body, i = body + ".*", i + 2
            elif text[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif text[i] == "?":
                body, i = body + "[^/]", i + 1
            elif text[i] == "[" and "]" in text[i + 1 :]:
                stop = text.index("]", i + 1)
                body, i = body + "[" + text[i + 1 : stop].replace("!", "^", 1) + "]", stop + 1
            elif text[i] == "\\" and i + 1 < len(text):
                body, i = body + re.escape(text[i + 1]), i + 2
            else:
                body, i = body + re.escape(text[i]), i + 1
        if text:
            found.append((negated, only_dirs, ("" if anchored else "(?:.*/)?") + body))
    return found


@lru_cache(maxsize=256)
def compiled_patterns(content: str) -> list[tuple[bool, bool, re.Pattern]]:
    """ignore_patterns(), compiled; many repositories have one ignore file between them."""
    found = []
    for negated, only_dirs, regex in ignore_patterns(content):
        try:
            found.append((negated, only_dirs, re.compile(regex, re.IGNORECASE)))
        except re.error:
            continue  # no pattern
    return found


class IgnoreTree:
    """The verdicts of one ignore file on a tree of folders: below an ignored folder everything is ignored.

    Patterns are compiled once; a folder is judged once, and its verdict is what its entries start from.
    """

    #: Folders whose verdicts are kept; they are judged anew beyond that.
    KEEP = 100_000

    def __init__(self, content: str) -> None:
        self.rules = compiled_patterns(content)
        self.folders: dict[str, bool] = {}

    def own_verdict(self, path: str, folder: bool) -> bool:
        """That of the last pattern which matches this path itself."""
        for negated, only_dirs, regex in reversed(self.rules):
            if (folder or not only_dirs) and regex.fullmatch(path):
                return not negated
        return False

    def folder_ignored(self, folder: str) -> bool:
        known = self.folders.get(folder)
        if known is None:
            above = folder.rpartition("/")[0]
            known = bool(above) and self.folder_ignored(above) or self.own_verdict(folder, True)
            if len(self.folders) >= self.KEEP:
                self.folders.clear()
            self.folders[folder] = known
        return known

    def ignored(self, path: str) -> bool:
        above = path.rpartition("/")[0]
        return bool(above) and self.folder_ignored(above) or self.own_verdict(path, False)


def ignored_paths(files: DataFrame, share: int = 200_000) -> DataFrame:
    """SRC02: repo_id, path of the files that their own repository's root ignore file leaves out.

    Only names travel. A repository's names are dealt by folder into as many groups as they need; its ignore file (one row) goes to each and comes
    first there, so that its patterns are compiled once a group.
    """
    import pyarrow as pa

    names = files.select("repo_id", "path").where("path IS NOT NULL").distinct()
    rules_ = files.where("path = '.gitignore'").groupBy("repo_id").agg(F.max("content").alias("content")).where("content IS NOT NULL")
    sizes = names.join(rules_.select("repo_id"), "repo_id").groupBy("repo_id").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    heads = rules_.join(sizes, "repo_id").select("repo_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("string").alias("path"), "content")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    tails = names.join(sizes, "repo_id").select("repo_id", F.pmod(F.xxhash64(folder), F.col("salts")).cast("int").alias("salt"), "path", F.lit(None).cast("string").alias("content"))
    dealt = heads.unionByName(tails).repartition("repo_id", "salt").sortWithinPartitions("repo_id", "salt", F.col("path").asc_nulls_first())

    def run(batches):
        now, tree = None, IgnoreTree("")
        for b in batches:
            gone = []
            for i, (repo, salt, path, content) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
                if (repo, salt) != now:
                    now, tree = (repo, salt), IgnoreTree(content or "")
                if path is not None and tree.ignored(path):
                    gone.append(i)
            few = pa.array(gone, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(few), b.column(2).take(few)], names=["repo_id", "path"])

    return dealt.mapInArrow(run, names.schema)


def without_ignored(files: DataFrame) -> DataFrame:
    """SRC02: files that their own repository's root ignore file leaves."""
    return files.join(ignored_paths(files), ["repo_id", "path"], "left_anti").select(*files.columns)


def walked(files: DataFrame) -> DataFrame:
    """SRC01: without excluded folders, other dot names, tests and too deep paths; without_ignored() comes before it."""
    parts = F.split("path", "/")
    fine = lambda p: ~p.isin(rules.EXCLUDED_DIRS) & (~p.startswith(".") | p.isin(rules.ALLOWED_DOT_NAMES))
    return with_names(files).where(F.forall(parts, fine) & (F.size(parts) - 1 <= rules.MAX_DEPTH) & ~F.col("basename").rlike(r"\.(test|spec)\.[jt]sx?\z"))


def file_kind(path: Column, basename: Column, ext: Column) -> Column:
    """SRC06: the first matching rule, in order; null where nothing parses the file."""
    named = lambda *names: basename.isin(*names)
    chain = [
        (named("package.json"), "package_json"), (basename.startswith(".env"), "env"), (named("docker-compose.yml", "docker-compose.yaml"), "compose"),
        (path.contains(".github/workflows/") & ext.isin(".yml", ".yaml"), "workflow"), (named(".gitlab-ci.yml", ".circleci"), "workflow"),
        (basename.isin(rules.CONFIG_FILE_NAMES), "config_name"), (named("requirements.txt"), "requirements"), (named("pyproject.toml"), "pyproject"),
        (named("setup.py"), "setup_py"), (named("Cargo.toml"), "cargo"), (named("go.mod"), "go_mod"), (ext == ".csproj", "csproj"),
        (basename.startswith("appsettings") & (ext == ".json"), "appsettings"), (named("web.config"), "web_config"), (named("pom.xml"), "pom"),
        (named("build.gradle", "build.gradle.kts"), "gradle"), (basename.rlike(r"^application(-\w+)?\.properties\z"), "properties"),
        (basename.rlike(r"^application(-\w+)?\.ya?ml\z"), "application_yml"), (named("Gemfile"), "gemfile"),
        ((basename == "database.yml") & path.contains("config"), "database_yml"), (named("composer.json"), "composer"), (named("Pipfile"), "pipfile"),
        (named("setup.cfg"), "setup_cfg"), (ext == ".tf", "terraform"), (ext.isin(rules.CODE_EXTENSIONS), "source"),
    ]
    out = F.when(*chain[0])
    for condition, kind in chain[1:]:
        out = out.when(condition, kind)
    return out


# --- monorepos -------------------------------------------------------------------------------

# Files that make a folder a package, and kinds in order of precedence.
MANIFESTS = ["package.json", "Cargo.toml", "go.mod", "pyproject.toml", "requirements.txt", "setup.py", "pubspec.yaml", "Gemfile"]
WORKSPACE_KINDS = ["npm-workspaces", "pnpm", "lerna", "turborepo", "nx"]


def workspace_patterns(files: DataFrame) -> DataFrame:
    """SRC15: repo_id, kind, rank, pattern of every marker file at a repository's root."""
    root = files.where(~F.col("path").contains("/"))
    listed = lambda json: F.from_json(json, "array<string>")
    field = lambda path: F.get_json_object("content", path)
    npm = F.coalesce(listed(field("$.workspaces")), listed(field("$.workspaces.packages")))
    block = F.regexp_extract("content", r"(?m)^packages:[ \t]*\n((?:[ \t]*-[^\n]*\n?|[ \t]*#[^\n]*\n?|[ \t]*\n)*)", 1)
    pnpm = F.transform(F.regexp_extract_all(block, F.lit(r"""(?m)^[ \t]*-[ \t]*['"]?([^'"#\n]+?)['"]?[ \t]*(?:#.*)?$"""), 1), lambda x: F.trim(x))
    lerna = F.coalesce(listed(field("$.packages")), F.when(F.try_parse_json("content").isNotNull(), F.array(F.lit("packages/*"))))
    fixed = lambda *names: F.array(*[F.lit(f"{n}/*") for n in names])
    rows = [("package.json", npm), ("pnpm-workspace.yaml", pnpm), ("lerna.json", lerna), ("turbo.json", fixed("packages", "apps")), ("nx.json", fixed("packages", "apps", "libs"))]
    out = None
    for rank, (name, patterns) in enumerate(rows):
        one = root.where(F.col("path") == name).select("repo_id", F.lit(WORKSPACE_KINDS[rank]).alias("kind"), F.lit(rank).alias("rank"), F.posexplode(patterns).alias("at", "pattern"))
        out = one if out is None else out.unionByName(one)
    return out


def workspace_packages(files: DataFrame) -> DataFrame:
    """SRC15/SRC16: repo_id, kind, package: folders with a manifest, of the first kind that has any, 500 at most.

    Only one trailing star is understood; a pattern without one names the parent of packages, or a package.
    """
    manifest = files.where(F.element_at(F.split("path", "/"), -1).isin(MANIFESTS) & F.col("path").contains("/"))
    folders = manifest.select("repo_id", F.regexp_replace("path", "/[^/]*$", "").alias("package")).distinct()
    parents = folders.select("repo_id", "package", F.regexp_replace("package", "/?[^/]*$", "").alias("parent"), F.element_at(F.split("package", "/"), -1).alias("leaf"))
    parents = parents.where(~F.col("leaf").startswith(".") & (F.col("leaf") != "node_modules"))
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"/\*\z", ""), r"\*\z", ""), r"^\./|/\z", "")
    wanted = workspace_patterns(files).withColumn("parent", cleaned).where(~F.col("parent").contains("*"))
    below = wanted.join(parents, ["repo_id", "parent"]).select("repo_id", "kind", "rank", "at", "package")
    direct = wanted.where(~F.col("pattern").endswith("*")).join(folders, (wanted["repo_id"] == folders["repo_id"]) & (wanted["parent"] == folders["package"])).select(wanted["repo_id"], "kind", "rank", "at", "package")
    found = below.unionByName(direct).groupBy("repo_id", "kind", "rank", "package").agg(F.min("at").alias("at"))
    best = found.groupBy("repo_id").agg(F.min("rank").alias("rank"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("repo_id").orderBy("at", "package"))
    return found.join(best, ["repo_id", "rank"]).withColumn("k", order).where(F.col("k") <= rules.MAX_PACKAGES).select("repo_id", "kind", "package")


def with_packages(evidences: DataFrame, packages: DataFrame) -> DataFrame:
    """SRC17: rows of files in a package once more, with the package's last name before the path in it."""
    own = evidences.join(packages.select("repo_id", "package"), "repo_id")
    inside = own.where(F.col("file").startswith(F.concat("package", F.lit("/"))))
    moved = F.concat(F.element_at(F.split("package", "/"), -1), F.substr("file", F.length("package") + 1))
    return evidences.unionByName(inside.withColumn("file", moved).drop("package"))
