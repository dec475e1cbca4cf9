"""Scans of source files and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a source file must not hold, and paths that must not be there.
PRIVATE_KEY = r"(?m)^-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----\s*$"
FORGE_TOKEN = r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"
LARGEST = 10_000_000
#: Paths of a default layout; every function takes another list.
FORBIDDEN = (
    r"(?i)(^|/)(\.git|\.cargo|\.tooling|\.preview|\.release-work|\.tmp-[^/]*|target|node_modules|dist|artifacts|patches|sdk-headers|sdk-libs|sdk-tools|winlibs)(/|$)",
    r"(?i)(^|/)(\.env(?:\..*)?|run-dev\.ps1|winlibs\.zip)$",
    r"(?i)\.(onnx|exe|dll|dmg|deb|appimage|pfx|p12|pem|key|mobileprovision|docx|download)$",
    r"(?i)^src-tauri/(binaries|runtime)/",
    r"(?i)^src-tauri/models/(?!manifest\.json$|ocr-manifest\.json$)",
)
#: Path, pattern and problem of files that must not hold something of their own.
IN_FILES = (
    ("src-tauri/Cargo.toml", r"\[patch\.crates-io\]|\.\./patches/", "machine-local registry patch"),
    ("src-tauri/Cargo.lock", r'name = "vswhom-sys"\r?\nversion = "0\.1\.3"\r?\n(?:dependencies|\r?\n)', "non-registry recovery lock entry"),
)


def text_problems(text: Column, path: Column | None = None, in_files: tuple = IN_FILES) -> Column:
    own = [F.when((path == name) & text.rlike(pattern), problem) for name, pattern, problem in in_files] if path is not None else []
    return F.array_compact(F.array(F.when(text.rlike(PRIVATE_KEY), "private-key material"), F.when(text.rlike(FORGE_TOKEN), "credential-like token"), *own))


def path_forbidden(path: Column, forbidden: tuple[str, ...] = FORBIDDEN) -> Column:
    out = F.lit(False)
    for pattern in forbidden:
        out = out | path.rlike(pattern)
    return out


def audited(files: DataFrame) -> DataFrame:
    """path and problems of files (path, length, content) that have any. A file with a NUL isn't searched as text."""
    text = F.when(~F.col("content").cast("string").contains("\0"), F.col("content").cast("string"))
    more = F.array_compact(F.array(F.when(F.col("length") > LARGEST, "too large"), F.when(path_forbidden(F.col("path")), "forbidden path")))
    return files.select("path", F.concat(more, F.coalesce(text_problems(text, F.col("path")), F.expr("cast(array() as array<string>)"))).alias("problems")).where(F.size("problems") > 0)


def manifest_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """pack and ok: whether a pack's files (pack, name, content) are just those of its manifest (pack, name, sha256, bytes), whole. A pack without files, or without a manifest, isn't."""
    own = files.select("pack", "name", F.octet_length("content").alias("n"), F.sha2("content", 256).alias("sum"))
    both = manifest.join(own, ["pack", "name"], "full_outer")
    same = (F.col("n") == F.col("bytes")) & (F.col("sum") == F.lower("sha256"))
    return both.groupBy("pack").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("ok"))


def manifest_ok(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row, ok: whether files (name, content) are just those of manifest (name, sha256, bytes), whole."""
    one = lambda d: d.withColumn("pack", F.lit(1))
    return manifest_status(one(files), one(manifest)).agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"))


def first_sound(packs: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The first of some candidate places (packs: pack, nth) that holds all its files whole; no row if none does."""
    return packs.join(manifest_status(files, manifest).where("ok"), "pack").orderBy("nth").limit(1).select("pack")
