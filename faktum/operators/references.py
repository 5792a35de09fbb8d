"""References that manifests, lock files and sources make to other packages and files.

Each text becomes an array of (locator_type, locator, kind, source, pin), all
by expressions; JSON manifests are taken apart as maps.  Lock files that are
JSON, TOML or YAML documents are read by an Arrow function; one that can't be
read gives no rows.
"""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.functions.identity import forge_purl, purl_python

FIELDS = ("locator_type", "locator", "kind", "source", "pin")


def _ref(kind: str, source: str, locator: Column, locator_type: str = "purl", pin: Column | None = None) -> Column:
    return F.struct(F.lit(locator_type).alias("locator_type"), locator.alias("locator"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), (F.lit(None).cast("string") if pin is None else pin.cast("string")).alias("pin"))


def purl(kind: str, name: Column, version: Column | None = None) -> Column:
    bare = F.regexp_replace(name, "@", "%40")
    return F.concat(F.lit(f"pkg:{kind}/"), bare, F.lit("") if version is None else F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def _exact(version: Column) -> Column:
    return F.when(version.rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+(?:[-+][0-9A-Za-z.\-+]*)?\z"), version)


def _entries(text: Column, *path: str) -> Column:
    own = F.get_json_object(text, "$." + ".".join(path))
    return F.coalesce(F.map_entries(F.from_json(own, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def package_json(text: Column) -> Column:
    deps = F.concat(_entries(text, "dependencies"), _entries(text, "optionalDependencies"))
    found = F.transform(deps, lambda e: _ref("dependency", "package.json", purl("npm", e["key"], _exact(e["value"]))))
    repo = F.coalesce(F.get_json_object(text, "$.repository.url"), F.get_json_object(text, "$.repository"))
    at = lambda k: F.get_json_object(text, f"$.{k}")
    none = F.array().cast("array<string>")
    # values that are paths of files, wherever they stand; keys are followed by a colon
    exported = F.when(at("exports").startswith("./"), F.array(at("exports"))).otherwise(F.regexp_extract_all(at("exports"), F.lit(r'"(\./[^"\\]*)"(?=\s*[,\]}])'), F.lit(1)))
    programs = F.when(at("bin").startswith("{"), F.map_values(F.from_json(at("bin"), "map<string,string>"))).otherwise(F.array(at("bin")))
    entry = F.concat(F.array(at("main"), at("module")), F.coalesce(exported, none), F.coalesce(programs, none))
    entry = F.array_distinct(F.filter(entry, lambda x: x.isNotNull() & (x != "") & ~x.contains("*")))
    local = F.transform(entry, lambda x: _ref("local", "package.json", x, "path"))
    forge = forge_purl(repo)
    return F.concat(found, local, F.when(forge.isNotNull(), F.array(_ref("repository", "package.json", forge))).otherwise(F.array().cast(_ARRAY)))


_ARRAY = "array<struct<locator_type:string,locator:string,kind:string,source:string,pin:string>>"


def requirements(text: Column) -> Column:
    """Exact pins only."""
    rows = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"(?:\A|[ \t])#.*\z", "")))
    pattern = r"\A([A-Za-z0-9][A-Za-z0-9._\-]*)(?:\[[^\]]*\])?[ \t]*==[ \t]*([0-9A-Za-z.!+_\-]+)(?=[\s;,]|\z)"
    rows = F.filter(rows, lambda x: x.rlike(pattern))
    return F.transform(rows, lambda x: _ref("dependency", "requirements.txt", purl_python(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)), pin=F.nullif(F.regexp_extract(x, r"--hash=sha256:([0-9a-f]{64})", 1), F.lit(""))))


def go_mod(text: Column) -> Column:
    pattern = r"\A(?:require[ \t]+)?([a-z0-9.\-]+\.[a-z]+(?:/[^\s]+)?)[ \t]+(v[0-9][^\s]*)"
    body = F.regexp_replace(F.regexp_replace(text, r"(?ms)^(?:replace|exclude|retract)[ \t]*\(.*?^\)", ""), r"(?m)^(?:replace|exclude|retract|module|go|toolchain)[ \t].*$", "")
    rows = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\A\s+", "")), lambda x: x.rlike(pattern))
    return F.transform(rows, lambda x: _ref("dependency", "go.mod", purl("golang", F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2))))


def go_sum(text: Column) -> Column:
    pattern = r"\A(\S+) (v[^\s/]+) h1:(\S+)"
    rows = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    return F.transform(rows, lambda x: _ref("dependency", "go.sum", purl("golang", F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)), pin=F.regexp_extract(x, pattern, 3)))


def yarn_lock(text: Column) -> Column:
    pattern = r"(?s)\A\"?((?:@[^@/\s]+/)?[^@\s\"]+)@.*?\n  version:? \"?([^\"\n]+)\"?"
    blocks = F.filter(F.split(text, r"\n\n+"), lambda x: F.regexp_replace(x, r"(?m)\A(?:#.*\n|\n)+", "").rlike(pattern))
    blocks = F.transform(blocks, lambda x: F.regexp_replace(x, r"(?m)\A(?:#.*\n|\n)+", ""))
    return F.transform(blocks, lambda x: _ref("dependency", "yarn.lock", purl("npm", F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)), pin=F.nullif(F.regexp_extract(x, r"\n  integrity (\S+)", 1), F.lit(""))))


def cargo_lock(text: Column) -> Column:
    blocks = F.filter(F.split(text, r"\[\[package\]\]"), lambda x: x.rlike(r'\n?name = "'))
    own = lambda x, k: F.nullif(F.regexp_extract(x, rf'(?m)^{k} = "([^"]*)"', 1), F.lit(""))
    return F.transform(blocks, lambda x: _ref("dependency", "cargo.lock", purl("cargo", own(x, "name"), own(x, "version")), pin=own(x, "checksum")))


def gemfile_lock(text: Column) -> Column:
    """Specs at an indent of four, in the GEM section."""
    section = F.regexp_extract(text, r"(?s)(?:\A|\n)GEM\n(.*?)(?:\n\n|\z)", 1)
    rows = F.filter(F.split(section, "\n"), lambda x: x.rlike(r"\A {4}[^\s(]+ \([^)]+\)"))
    return F.transform(rows, lambda x: _ref("dependency", "gemfile.lock", purl("gem", F.regexp_extract(x, r"\A {4}(\S+)", 1), F.regexp_extract(x, r"\(([^)]+)\)", 1))))


#: registry, name and tag of a container action
IMAGE = r"\Adocker://(?:([A-Za-z0-9][A-Za-z0-9._:\-]*(?:/[A-Za-z0-9][A-Za-z0-9._:\-]*)*)/)?([A-Za-z0-9._\-]+)(?::([A-Za-z0-9._\-]+))?\z"


def _image(uses: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(uses, IMAGE, k), F.lit(""))
    marks = F.concat_ws("&", F.concat(F.lit("repository_url="), F.replace(part(1), F.lit("/"), F.lit("%2F"))), F.concat(F.lit("tag="), part(3)))
    return F.concat(F.lit("pkg:oci/"), F.lower(part(2)), F.when(marks != "", F.concat(F.lit("?"), marks)).otherwise(""))


def workflow(text: Column) -> Column:
    uses = F.regexp_extract_all(text, F.lit(r"""(?m)^\s*(?:-\s+)?uses:\s*['"]?([^\s'"#]+)"""), F.lit(1))
    is_action = lambda x: x.rlike(r"\A[^./][^/@]*/[^@]+@.+\z") & ~x.startswith("docker:")
    action = lambda x: F.concat(F.lit("pkg:github/"), F.array_join(F.slice(F.split(F.substring_index(x, "@", 1), "/"), 1, 2), "/"), F.lit("@"), F.substring_index(x, "@", -1))
    used = F.filter(uses, lambda x: is_action(x) | (x.rlike(IMAGE) & ~x.contains("..")))
    found = F.transform(used, lambda x: _ref("dependency", "github_actions", F.when(x.startswith("docker:"), _image(x)).otherwise(action(x))))
    local = F.transform(F.filter(uses, lambda x: x.startswith("./")), lambda x: _ref("local", "github_actions", x, "path"))
    return F.concat(found, local)


def relative_imports(text: Column) -> Column:
    """Distinct, in the order first seen."""
    own = F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"](\.{1,2}/[^'"\n]*)['"]"""), F.lit(1)))
    return F.transform(own, lambda x: _ref("local", "javascript", x, "path"))


def pkgbuild(text: Column) -> Column:
    """Source urls with their sha256 pins, and dependencies."""
    own = lambda k: F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{k} = (.+)$"), F.lit(1))
    sums = own("sha256sums")
    urls = F.transform(own("source"), lambda x, i: F.struct(F.regexp_replace(x, r"\A[^:]*::", "").alias("u"), F.try_element_at(sums, i + 1).alias("s")))
    urls = F.filter(urls, lambda x: x["u"].contains("://"))
    found = F.transform(urls, lambda x: _ref("url_fetch", "src_info", x["u"], "url", F.when(x["s"] != "SKIP", x["s"])))
    deps = F.transform(own("depends"), lambda x: _ref("dependency", "src_info", purl("alpm/arch", F.regexp_extract(x, r"\A[^<>=:\s]+", 0))))
    return F.concat(found, deps)


def cargo_toml(text: Column) -> Column:
    """The repository; dependencies are ranges, which the lock file resolves."""
    section = F.regexp_extract(text, r"(?ms)^\[package\][ \t]*\r?$(.*?)(?=^\[|\z)", 1)
    url = F.nullif(F.regexp_extract(section, r"""(?m)^[ \t]*repository[ \t]*=[ \t]*["']([^"'\n]+)["']""", 1), F.lit(""))
    forge = forge_purl(url)
    return F.when(forge.isNotNull(), F.array(_ref("repository", "cargo.toml", forge))).when(url.isNotNull(), F.array(_ref("repository", "cargo.toml", url, "url"))).otherwise(F.array().cast(_ARRAY))


def _npm(name: str, version: str) -> str:
    return f"pkg:npm/{name.replace('@', '%40')}@{version}"


def _pypi(name: str, version: str) -> str:
    return f"pkg:pypi/{re.sub('[-_.]+', '-', name.lower())}@{version}"


def _integrity(own) -> str | None:
    first = own.split()[0] if isinstance(own, str) and own.split() else ""
    return first if re.match(r"sha(?:1|256|512)-.", first) else None


def _maps(own) -> list[tuple[str, dict]]:
    return [(k, v) for k, v in own.items() if isinstance(k, str) and isinstance(v, dict)] if isinstance(own, dict) else []


def _packages(own) -> list[tuple[str, str]]:
    return [(x["name"], x["version"]) for x in own if isinstance(x, dict) and isinstance(x.get("name"), str) and isinstance(x.get("version"), str)] if isinstance(own, list) else []


def _package_lock(text: str) -> list[tuple[str, str | None]]:
    own = json.loads(text)
    named = [(k.rsplit("node_modules/", 1)[1], v) for k, v in _maps(own.get("packages")) if "node_modules/" in k] + _maps(own.get("dependencies"))
    return [(_npm(k, v["version"]), _integrity(v.get("integrity"))) for k, v in named if k and isinstance(v.get("version"), str)]


def _pnpm_lock(text: str) -> list[tuple[str, str | None]]:
    import yaml

    out = []
    for k, v in _maps((yaml.load(text, yaml.BaseLoader) or {}).get("packages")):
        name, _, version = k.lstrip("/").partition("(")[0].rpartition("@")
        if name and version:
            out.append((_npm(name, version), _integrity(dict(_maps(v)).get("resolution", {}).get("integrity"))))
    return out


def _poetry_lock(text: str) -> list[tuple[str, str | None]]:
    return [(_pypi(*x), None) for x in _packages(tomllib.loads(text).get("package"))]


def _pipfile_lock(text: str) -> list[tuple[str, str | None]]:
    own = json.loads(text)
    rows = [(k, v["version"].lstrip("=")) for section in ("default", "develop") for k, v in _maps(own.get(section)) if isinstance(v.get("version"), str)]
    return [(_pypi(k, v), None) for k, v in rows if v]


def _composer_lock(text: str) -> list[tuple[str, str | None]]:
    own = json.loads(text)
    return [(f"pkg:composer/{k}@{v}", None) for section in ("packages", "packages-dev") for k, v in _packages(own.get(section))]


#: Lock files by type.
LOCKS = {"package-lock.json": _package_lock, "pnpm-lock.yaml": _pnpm_lock, "poetry.lock": _poetry_lock, "pipfile.lock": _pipfile_lock, "composer.lock": _composer_lock}


def locked(kind: str, text: str | None) -> list[dict]:
    try:
        rows = LOCKS[kind](text) if text else []
    except Exception:  # hostile input is data
        rows = []
    return [{"locator_type": "purl", "locator": x, "kind": "dependency", "source": kind, "pin": pin} for x, pin in rows]


def _locks(kind: Column, text: Column) -> Column:
    def run(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([locked(k, t) if k in LOCKS else [] for k, t in zip(kinds, texts, strict=True)], dtype=object)

    mine = kind.isin(list(LOCKS))
    return F.pandas_udf(run, _ARRAY)(kind, F.when(mine, text))


SOURCES = {
    "package.json": package_json, "requirements.txt": requirements, "go.mod": go_mod, "go.sum": go_sum, "yarn.lock": yarn_lock, "cargo.lock": cargo_lock, "gemfile.lock": gemfile_lock, "github_actions": workflow,
    "javascript": relative_imports, "typescript": relative_imports, "src_info": pkgbuild, "cargo.toml": cargo_toml,
}


def references(files: DataFrame) -> DataFrame:
    """files: (file_id, file_type, text) to (file_id, ord, locator_type, locator, kind, source, pin)."""
    own = F.when(F.col("file_type").isin(list(LOCKS)), _locks(F.col("file_type"), F.col("text"))).otherwise(F.array().cast(_ARRAY))
    for kind, f in SOURCES.items():
        own = F.when(F.col("file_type") == kind, f(F.col("text")).cast(_ARRAY)).otherwise(own)
    return files.select("file_id", F.posexplode(own).alias("ord", "x")).select("file_id", "ord", *(F.col(f"x.{k}").alias(k) for k in FIELDS))


def package_references(facts: DataFrame) -> DataFrame:
    """facts of gem and vsix packages (file_id, ord, key, value) to what they depend on, as references without versions; names of extensions are `publisher.name`."""
    publisher, name = F.substring_index("value", ".", 1), F.expr("substring(value, instr(value, '.') + 1)")
    extension = F.when(F.col("value").contains(".") & (publisher != "") & (name != ""), F.concat(F.lit("pkg:vscode/"), publisher, F.lit("/"), name))
    locator = F.when(F.col("key") == "runtime_dependency", F.concat(F.lit("pkg:gem/"), F.nullif("value", F.lit("")))).when(F.col("key") == "dependency", extension)
    source = F.when(F.col("key") == "dependency", "vsix.dependencies").otherwise("gem.runtime_dependencies")
    return facts.select("file_id", "ord", F.lit("purl").alias("locator_type"), locator.alias("locator"), F.lit("dependency").alias("kind"), source.alias("source")).filter("locator IS NOT NULL")
