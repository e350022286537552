"""Which files of a source tree count: ignore files of every folder, fixed lists and globs, in layers.

Each pattern of an ignore file becomes a regex below its folder. An entry, which is a file or one of its folders, asks the
files of all folders above it; among matching patterns the last one decides, and a "!" lets the entry in again. A file is
out if it is, or any folder above it, so nothing below a folder that is out can be let in.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .files import MOST_BYTES, path_glob

# fixed values: folders, extensions and names that hold no source code of a project's own
SKIPPED_FOLDERS = (
    ".git .svn .hg node_modules vendor venv .venv third_party 3rdparty jspm_packages bower_components site-packages eggs .eggs .tox wheels lib64 dist build target out bin generated auto-generated .generated "
    ".terraform .serverless __pycache__ .pytest_cache .mypy_cache .cache .nyc_output .next .nuxt .parcel-cache .turbo .svelte-kit .idea .vscode .vs .eclipse .settings coverage .coverage fixtures snapshots __snapshots__ .circleci .gitlab"
).split()
SKIPPED_EXTENSIONS = (
    ".png .jpg .jpeg .gif .ico .svg .webp .ttf .otf .woff .woff2 .eot .exe .dll .so .dylib .a .lib .o .obj .class .jar .war .wasm .node .zip .tar .gz .rar .7z .pdf .doc .docx .xls .xlsx .ppt .pptx .mp3 .mp4 .wav .avi .mov .mkv "
    ".pem .key .crt .cer .p12 .pfx .csv .tsv .parquet .avro .h5 .hdf5 .npy .npz .pkl .pickle .db .sqlite .sqlite3 .mdb .lock .map .bin .dat .data .raw .iso .img .dmg .pyc .pyo .swp .swo"
).split()
SKIPPED_NAMES = (
    ".DS_Store Thumbs.db desktop.ini .gitkeep package-lock.json yarn.lock pnpm-lock.yaml composer.lock Gemfile.lock poetry.lock Cargo.lock go.sum .npmrc .yarnrc .editorconfig .prettierrc .prettierignore .eslintignore .dockerignore "
    "LICENSE LICENSE.md LICENSE.txt CHANGELOG.md CONTRIBUTING.md CODE_OF_CONDUCT.md SECURITY.md .env .env.local .env.development .env.production .env.test .env.example"
).split()


def rule_regex(line: str, folder: str) -> tuple[str, bool, bool] | None:
    """(regex on paths, lets in, folders only) of a line of the ignore file in `folder` ("" is the root); None for no pattern."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    lets_in = line.startswith("!")
    line = line[1:] if lets_in else line.removeprefix("\\") if line[:2] in ("\\!", "\\#") else line
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    parts = line.removeprefix("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    return (re.escape(folder) + "/" if folder else "") + out, lets_in, only_folders


def _segment(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inside = glob[k + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^/" + inside[1:] if inside[0] in "!^" else inside) + "]"
            k = close
        else:
            if c == "\\" and k + 1 < len(glob):
                k, c = k + 1, glob[k + 1]
            out += re.escape(c)
        k += 1
    return out


_RULES = "array<struct<regex:string,lets_in:boolean,only_folders:boolean>>"


def _compiled_series(texts: pd.Series, folders: pd.Series) -> pd.Series:
    def rules(text: str | None, folder: str) -> list[dict]:
        found = (rule_regex(line, folder) for line in (text or "").split("\n"))
        return [dict(zip(("regex", "lets_in", "only_folders"), r, strict=True)) for r in found if r]

    return pd.Series([rules(t, f) for t, f in zip(texts, folders, strict=True)])


def _said(rules: Column, path: Column, folder: Column) -> Column:
    """What the last rule that fits says: true lets in, false keeps out, null says nothing."""
    return F.aggregate(rules, F.lit(None).cast("boolean"), lambda a, r: F.when((folder | ~r["only_folders"]) & F.rlike(path, F.concat(F.lit(r"^(?:"), r["regex"], F.lit(r")\z"))), r["lets_in"]).otherwise(a))


def collected(files: DataFrame, ignores: DataFrame, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, language, size) of those files(path, size) that count, by ignores(folder, layer, text).

    Paths are relative to the root, whose folder is "". Layers: the project's `own` ignore files come first; where these say
    nothing, folders and names of the fixed lists are out, and what they let in escapes these lists and the skipped
    extensions alone. Then `git` ignore files and the globs of `exclude` keep out. Last, a file needs a known language and
    no more than `most_bytes`. Null paths are left out; of repeated ones each row is judged alike; two files of one folder
    and layer are read as one, in order of their texts.
    """
    compiled = ignores.groupBy("folder", "layer").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    compiled = compiled.select("folder", "layer", F.pandas_udf(_compiled_series, _RULES)("text", "folder").alias("rules")).groupBy("folder").agg(F.first(F.when(F.col("layer") == "own", F.col("rules")), ignorenulls=True).alias("own"), F.first(F.when(F.col("layer") == "git", F.col("rules")), ignorenulls=True).alias("git"))

    parts = F.split("path", "/")
    paths = files.select("path").filter("path is not null").distinct()
    # every file and folder once, however many files are below it
    entries = paths.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("entry"), (n < F.size(parts)).alias("is_folder")))).alias("k", "e"))
    entries = entries.select("e.*").distinct()
    own = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda n: F.array_join(F.slice(own, F.lit(1), n), "/"))
    asked = entries.select("entry", "is_folder", F.posexplode(above).alias("depth", "folder")).join(compiled, "folder")
    said = asked.select("entry", "is_folder", "depth", *[_said(F.col(c), F.col("entry"), F.col("is_folder")).alias(c) for c in ("own", "git")])
    # the deepest folder whose rules say something decides
    last = said.groupBy("entry", "is_folder").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("depth", c)))[c].alias(c) for c in ("own", "git")])
    name = F.regexp_extract("entry", r"[^/]*\z", 0)
    globs = F.lit(False)
    for g in exclude or []:
        globs = globs | F.col("entry").rlike(path_glob(g))
    in_lists = F.when(F.col("is_folder"), name.isin(SKIPPED_FOLDERS)).otherwise(name.isin(SKIPPED_NAMES) | F.lower(X.extension(F.col("entry"))).isin(SKIPPED_EXTENSIONS) | name.rlike(r"\.min\.(js|css)\z"))
    let_in = F.coalesce(F.col("own"), F.lit(False))
    out = (~F.coalesce("own", F.lit(True))) | (in_lists & ~let_in) | ~F.coalesce("git", F.lit(True)) | globs
    judged = entries.join(last, ["entry", "is_folder"], "left").select("entry", "is_folder", out.alias("out"))
    bad_folders, bad_files = judged.filter("out and is_folder").select(F.col("entry").alias("folder")), judged.filter("out and not is_folder").select(F.col("entry").alias("path"))
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n - 1), "/"))
    below = paths.select("path", F.explode(folders).alias("folder")).join(bad_folders, "folder", "left_semi").select("path").distinct()
    kept = files.join(below, "path", "left_anti").join(bad_files, "path", "left_anti")
    return kept.select("path", X.language(F.col("path")).alias("language"), "size").filter(F.col("path").isNotNull() & F.col("language").isNotNull() & (F.coalesce("size", F.lit(0)) <= most_bytes))
