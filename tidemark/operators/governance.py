"""Schema rules and content scans."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a scan of text looks for. Addresses of documentation ranges don't count.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
QUAD = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"
DOCUMENTATION = r"^(?:192\.0\.2|198\.51\.100|203\.0\.113)\."
#: Files that must not be published, by folder, name and ending, and names that may.
FOLDER, NAMES, MAY = "data", ("my_spotify_data.zip", "token.json"), (".env.example",)
ENDINGS = (".mp3", ".m4a", ".wav", ".flac", ".ogg", ".aac", ".duckdb", ".parquet")
NAMED_LIKE = r"^(?:Streaming_History_.*\.json|\.env(?:\..+)?)$"
#: What published content must not hold.
SECRETS = {
    "API key": r"sk-ant-[A-Za-z0-9_-]{20,}",
    "refresh token": r'"refresh_token"\s*:\s*"[A-Za-z0-9_-]{20,}"',
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
ADDRESS = r'"ip_addr"\s*:\s*"([0-9a-fA-F.:]{7,})"'
MAY_ADDRESS = r"^(?:192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|2001:db8:|2001:DB8:)"
SYNTHETIC, PRIVATE = r'"audience"\s*:\s*"synthetic"', r'"audience"\s*:\s*"private"'
REPORTS, ASSETS, WEB = r"^web/public/(?:rewind|wrapped)/.*\.json$", r"^web/public/", r"^web/"
CLOCK, HOURLY = "America/Chicago", r'"(?:by_hour|hour_local)"'
LYRICS = r'"(?:plainLyrics|syncedLyrics)"\s*:\s*"(?:[^"\\]|\\.){200}'
CRATE_COLUMNS = ("track_id", "name", "artist", "tempo", "energy", "duration_ms", "familiar", "mood_tags", "fly_valence", "taste", "kc")
COARSE_FORBIDDEN = ("plays", "sessions")


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]


def coarse_violations(tables: dict[str, DataFrame]) -> list[str]:
    """What keeps a set of tables from being shipped as the coarse warehouse."""
    out = [f"table {t} must not be shipped" for t in COARSE_FORBIDDEN if t in tables]
    return out + [f"{t}.{c} is a time" for t, df in sorted(tables.items()) for c in temporal_columns(df)]


def check_crate(df: DataFrame) -> DataFrame:
    """The crate itself, if it has exactly the allowed columns and none is a time."""
    if set(df.columns) != set(CRATE_COLUMNS):
        raise ValueError(f"columns must be {sorted(CRATE_COLUMNS)}, not {sorted(df.columns)}")
    if found := temporal_columns(df):
        raise ValueError(f"no column may be a time: {found}")
    return df


def personal_data(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Number of e-mail and network addresses in each text that has any."""
    quads = F.filter(F.regexp_extract_all(text, F.lit(QUAD), F.lit(0)), lambda q: ~q.rlike(DOCUMENTATION))
    got = docs.select(key, F.size(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))).alias("emails"), F.size(quads).alias("addresses"))
    return got.where("emails > 0 or addresses > 0")


def path_problem(path: str) -> F.Column:
    """Why a file of this path must not be published; null if it may."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    name = F.substring_index(p, "/", -1)
    ending = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return (
        F.when(name.isin(*MAY), None)
        .when(F.startswith(p, F.lit(f"{FOLDER}/")) | (p == FOLDER), "derived from personal data")
        .when(name.isin(*NAMES), "personal data")
        .when(ending.isin(*ENDINGS), "audio or warehouse data")
        .when(name.rlike(NAMED_LIKE), "raw export or secrets")
    )


def file_problems(files: DataFrame, path: str = "path", text: str = "text", key: str | None = None) -> DataFrame:
    """(path, or `key`, and problem): what keeps each file from being published, by its path, its content and, of reports, its markers.

    Null content counts as empty. One scan, no shuffle.
    """
    p, c = F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.coalesce(F.col(text), F.lit(""))
    has = lambda pattern: c.rlike(pattern)
    real = F.exists(F.regexp_extract_all(c, F.lit(ADDRESS), F.lit(1)), lambda a: ~a.rlike(MAY_ADDRESS))
    audience = F.get_json_object(c, "$.audience")
    public = p.rlike(REPORTS)
    privacy = F.coalesce(F.get_json_object(c, "$.privacy"), F.lit(""))
    found = [
        path_problem(path),
        *[F.when(has(pattern), label) for label, pattern in SECRETS.items()],
        F.when(real, "ip_addr value"),
        F.when(has(PRIVATE), "private report"),
        F.when(public & ~F.equal_null(audience, F.lit("synthetic")), "public report not marked synthetic"),
        F.when(public & (audience == "synthetic") & F.endswith(p, F.lit("/index.json")) & privacy.isin("", "{}", "[]", "false", "0"), "no privacy note"),
        F.when(p.rlike(ASSETS) & ~has(SYNTHETIC) & F.contains(c, F.lit(CLOCK)) & has(HOURLY), "hourly counts on a real clock"),
        F.when(p.rlike(WEB) & has(LYRICS), "lyrics"),
    ]
    return files.select(F.col(key or path), F.explode(F.array_compact(F.array(*found))).alias("problem"))


#: Bytes of an archive member that are looked at, and of a file at most.
SCANNED_BYTES = 8 << 20


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "member", "text"]
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            data = data or b""
            try:
                if path.lower().endswith(".zip"):
                    archive = zipfile.ZipFile(io.BytesIO(data))
                    parts = ((info.filename, archive.open(info)) for info in archive.infolist() if not info.is_dir())
                elif path.lower().endswith(".gz"):
                    parts = iter([(path.rsplit("/", 1)[-1][:-3], gzip.GzipFile(fileobj=io.BytesIO(data)))])
                else:
                    parts = iter([(None, io.BytesIO(data))])
                # a member at a time, so that an archive is never unpacked whole
                for member, stream in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, member, stream.read(SCANNED_BYTES).decode("utf-8", "replace"))], names)
            except (OSError, EOFError, zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError):
                continue  # what can't be unpacked holds nothing that could be read


def unpacked(files: DataFrame) -> DataFrame:
    """(path, member, text) of files (path, content as bytes): of zip archives each member, of gzip files what they hold, and
    other files themselves with a null member. Broken archives give no row; bytes that aren't text are replaced."""
    return files.select("path", "content").mapInArrow(_members, "path string, member string, text string")


def archive_problems(files: DataFrame) -> DataFrame:
    """(path, member, problem) of files and of what archives hold. A member is judged by its own name too, but raw history in an
    archive isn't a problem of its own, and gzip files are judged as the file without the ending."""
    own = unpacked(files)
    inside = F.endswith(F.lower("path"), F.lit(".zip")) & F.col("member").isNotNull()
    shown = F.when(inside, F.col("member")).otherwise(F.regexp_replace("path", r"(?i)\.gz$", ""))
    found = file_problems(own.select(F.struct("path", "member", shown.alias("shown")).alias("file"), shown.alias("shown"), "text"), "shown", "text", "file")
    history = F.contains("file.member", F.lit("Streaming_History")) & (F.col("problem") == "raw export or secrets")
    return found.where(~F.coalesce(history & F.endswith(F.lower("file.path"), F.lit(".zip")), F.lit(False))).select("file.path", "file.member", "problem")


#: What a request to save a list may hold.
NAME_CHARS, LIST_TRACKS, TRACK = 100, 500, "^spotify:track:[A-Za-z0-9]{22}$"


def refusal(name: str = "name", uris: str = "uris") -> F.Column:
    """Why a request isn't carried out, by the first rule that it breaks; null if it may be. A null list is empty."""
    own = F.coalesce(uris, F.array().cast("array<string>"))
    bad = F.size(F.filter(own, lambda u: ~F.coalesce(u.rlike(TRACK), F.lit(False))))
    return (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "no name")
        .when(F.length(name) > NAME_CHARS, F.lit(f"name of more than {NAME_CHARS} characters"))
        .when(F.size(own) > LIST_TRACKS, F.format_string(f"more than {LIST_TRACKS} tracks: %d", F.size(own)))
        .when(bad > 0, F.format_string("no track: %d", bad))
    )
