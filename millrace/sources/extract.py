"""Configured extracts: a query source, chunked CSV files, upload, clean-up, notification and exit codes.

The source is any Spark reader; a database is read over JDBC with the configured fetch size. Network parts (secret store,
upload, mail) sit behind functions that a caller may replace.
"""

from __future__ import annotations

import argparse
import json
import logging
import smtplib
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from email.message import EmailMessage
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.checkpoints import cut
from millrace.sources.csv_files import remove_files, write_chunks

# Exit codes by kind of failure.
EXIT_CODES = {"ok": 0, "generic": 1, "config": 2, "secrets": 3, "connect": 4, "query": 5, "csv": 6, "upload": 7, "unexpected": 99, "interrupt": 130}
# Keys whose values never reach a log.
SENSITIVE_KEYS = {"password", "passwd", "pwd", "secret", "token", "access_key", "secret_key", "secret_access_key", "aws_secret_access_key", "kms_key_id"}


class ExtractError(Exception):
    kind = "generic"


class ConfigError(ExtractError):
    kind = "config"


class SecretsError(ExtractError):
    kind = "secrets"


class ConnectError(ExtractError):
    kind = "connect"


class QueryError(ExtractError):
    kind = "query"


class CsvError(ExtractError):
    kind = "csv"


class UploadError(ExtractError):
    kind = "upload"


#: Levels of nesting that :func:`redact` copies.
REDACTED_LEVELS = 20


def redact(value):
    """A copy of nested mappings and lists (tuples become lists) in which every sensitive key with a value reads as masked.
    What lies deeper than ``REDACTED_LEVELS`` is replaced by a mark. Works off a list of places, without recursion."""
    top = [value]
    places = [(top, 0, 0)]
    while places:
        holder, place, level = places.pop()
        found = holder[place]
        if level > REDACTED_LEVELS:
            holder[place] = "<max-depth>"
        elif isinstance(found, dict):
            holder[place] = copy = dict(found)
            for key, inner in copy.items():
                if inner and str(key).lower() in SENSITIVE_KEYS:
                    copy[key] = "***REDACTED***"
                else:
                    places.append((copy, key, level + 1))
        elif isinstance(found, (list, tuple)):
            holder[place] = copy = list(found)
            places += [(copy, i, level + 1) for i in range(len(copy))]
    return top[0]


def human_bytes(n: float) -> str:
    """Bytes with two decimals in the largest binary unit that leaves at least one of it."""
    step = min(max(int(n), 1).bit_length() - 1, 49) // 10
    return f"{n / 2 ** (10 * step):.2f} {('B', 'KiB', 'MiB', 'GiB', 'TiB')[step]}"


def rate(count: int, seconds: float) -> str:
    """A count by second; the bare count where no time went by."""
    speed = f"{count / seconds:.1f}" if seconds > 0 else str(count)
    return speed + "/s"


@dataclass
class Config:
    oracle: dict
    sql: str
    output: dict
    s3: dict
    fetch: dict = field(default_factory=dict)
    cleanup_local: bool = True
    debug: bool = False
    logging: dict = field(default_factory=dict)
    notifications: dict = field(default_factory=dict)

    @property
    def records_per_file(self) -> int:
        return int(self.output["records_per_file"])

    @property
    def csv(self) -> dict:
        return {"delimiter": ",", "include_header": True, "quote_all": False} | (self.output.get("csv") or {})


def _section(raw: dict, name: str, needed: tuple[str, ...]) -> dict:
    part = raw[name]
    if not isinstance(part, dict):
        raise ConfigError(f"{name} must be a mapping")
    for key in needed:
        if key not in part:
            raise ConfigError(f"{name}.{key} is required")
    return part


def parse_config(raw) -> Config:
    """Check a mapping and wrap it; every fault is a ConfigError."""
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    missing = [k for k in ("oracle", "sql", "output", "s3") if k not in raw]
    if missing:
        raise ConfigError(f"required keys are missing: {', '.join(missing)}")
    oracle = _section(raw, "oracle", ("dsn",))
    for key, kind in {"thick_mode": bool, "client_lib_dir": str, "client_config_dir": str}.items():
        if key in oracle and not isinstance(oracle[key], kind):
            raise ConfigError(f"oracle.{key} must be a {kind.__name__}, got {oracle[key]!r}")
    needs = {"plain": ("user", "password"), "aws_secret": ("secret_name",)}
    method = str(oracle.get("auth_method", "plain")).lower()
    if method not in needs:
        raise ConfigError(f"oracle.auth_method must be one of {sorted(needs)}, got {method!r}")
    if not all(oracle.get(k) for k in needs[method]):
        raise ConfigError(f"oracle.auth_method {method} requires {' and '.join(needs[method])}")
    output = _section(raw, "output", ("local_dir", "base_filename", "records_per_file"))
    try:
        per_file = int(output["records_per_file"])
    except (TypeError, ValueError) as e:
        raise ConfigError(f"output.records_per_file must be a whole number, got {output['records_per_file']!r}") from e
    if per_file <= 0:
        raise ConfigError("output.records_per_file must be positive")
    s3 = _section(raw, "s3", ("bucket",))
    more = {k: raw[k] for k in ("fetch", "cleanup_local", "debug", "logging", "notifications") if raw.get(k) is not None}
    return Config(oracle, raw["sql"], output, s3, **more)


def load_config(path: str) -> Config:
    import yaml

    try:
        return parse_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except OSError as e:
        raise ConfigError(f"cannot read {path}: {e}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e


def aws_secret(name: str, region: str | None) -> dict:
    """User and password from the secret store, if its client library is installed."""
    try:
        import boto3
    except ImportError as e:
        raise SecretsError("the client library of the secret store is not installed") from e
    try:
        found = json.loads(boto3.client("secretsmanager", region_name=region).get_secret_value(SecretId=name)["SecretString"])
        return {"user": found.get("user") or found["username"], "password": found["password"]}
    except Exception as e:
        raise SecretsError(f"secret {name} cannot be read: {type(e).__name__}") from e


#: Slices of the key's range that are counted for each partition of a read.
SLICES = 16


def plan_ranges(reader: DataFrameReader, sql: str, column: str, parts: int) -> list[str]:
    """Predicates that deal the rows of a query over about ``parts`` partitions by a whole-number column.

    The database counts the rows of ``SLICES`` equal slices of the key's range for each partition, and again within a slice that
    holds more than a partition's share; neighbouring slices are put together until a partition has its share. Only the rows of
    one key cannot be dealt out. Null keys are a partition of their own, if there are any.
    """
    ask = lambda q: reader.option("query", q).load()
    low, high, n, known = ask(f"SELECT MIN({column}) AS A, MAX({column}) AS B, COUNT(*) AS N, COUNT({column}) AS K FROM ({sql}) q").first()
    nulls = [f"{column} IS NULL"] if n > known else []
    if not known:
        return nulls or ["1 = 0"]
    share, todo, slices = int(known) / parts, [(int(low), int(high))], []
    while todo:
        low, high = todo.pop()
        width = max(1, -(-(high - low + 1) // (SLICES * parts)))
        counts = ask(f"SELECT S, COUNT(*) AS N FROM (SELECT FLOOR(({column} - ({low})) / {width}.0) AS S FROM ({sql}) q WHERE {column} BETWEEN {low} AND {high}) p GROUP BY S").collect()  # SLICES * parts rows
        for start, rows in ((low + int(r[0]) * width, int(r[1])) for r in counts):
            if rows > share and width > 1:
                todo.append((start, min(high, start + width - 1)))
            else:
                slices.append((start, rows))
    bounds, held = [], 0
    for start, rows in sorted(slices):
        if held and held + rows / 2 > share:
            bounds.append(start)
            held = 0
        held += rows
    edges = [None, *bounds, None]
    return nulls + [" AND ".join(([f"{column} >= {a}"] if a is not None else []) + ([f"{column} < {b}"] if b is not None else []) or [f"{column} IS NOT NULL"]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def jdbc_reader(spark: SparkSession, config: Config, secrets: Callable[[str, str | None], dict] = aws_secret, url: str | None = None) -> DataFrame:
    """The configured query over JDBC. ``fetch.partition_column`` reads it in ``num_partitions`` partitions: with the bounds that
    are given, or by ranges that follow the column's distribution (:func:`plan_ranges`)."""
    login = config.oracle
    if str(login.get("auth_method", "plain")).lower() == "aws_secret":
        login = secrets(login["secret_name"], login.get("aws_region"))
    url = url or f"jdbc:oracle:thin:@{config.oracle['dsn']}"
    options = {"user": login["user"], "password": login["password"], "fetchsize": str(config.fetch.get("array_size", 5000))}
    reader = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    column = config.fetch.get("partition_column")
    if not column:
        return reader().option("query", config.sql).load()
    if "lower_bound" in config.fetch:
        bounds = {k: config.fetch[v] for k, v in (("lowerBound", "lower_bound"), ("upperBound", "upper_bound"), ("numPartitions", "num_partitions"))}
        return reader().options(dbtable=f"({config.sql}) q", partitionColumn=column, **bounds).load()
    predicates = plan_ranges(reader(), config.sql, column, int(config.fetch.get("num_partitions", 8)))
    return spark.read.jdbc(url, f"({config.sql}) q", predicates=predicates, properties=options)


def write_csv_files(df: DataFrame, local_dir: str, base: str, records_per_file: int, delimiter: str = ",", include_header: bool = True, quote_all: bool = False, order: tuple[str, ...] = ()) -> list[dict]:
    """Files ``<base>_1.csv``, ``<base>_2.csv``, ... of ``records_per_file`` rows each (the last may have fewer), as the entries
    (chunk, path, rows, bytes) of their manifest.

    Rows are numbered across partitions; tasks write whole files side by side, under their names (:mod:`csv_files`). Without
    rows no file is written.
    """
    line = csv_line(df, delimiter, quote_all)
    numbered = number_rows(df, order or tuple(df.columns))
    rows = numbered.select(F.floor(F.col("_n") / records_per_file).alias("_chunk"), "_n", line.alias("_line"))
    rows = rows.repartition("_chunk").sortWithinPartitions("_chunk", "_n").select("_chunk", "_line")
    head = delimiter.join(_quoted(c, delimiter, quote_all) for c in df.columns) if include_header else None
    return write_chunks(rows, local_dir, base, head)


def _quoted(text: str, delimiter: str, always: bool) -> str:
    return '"' + text.replace('"', '""') + '"' if always or any(c in text for c in (delimiter, '"', "\r", "\n")) else text


def csv_line(df: DataFrame, delimiter: str = ",", quote_all: bool = False):
    """A row as CSV text: quotes doubled, null empty, line ends inside a field kept as they are. Spark's own writer changes
    those to the line separator. Floats read as Spark prints them."""

    def text(f):
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "boolean":
            return F.when(c, "True").when(~c, "False")
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.cast("string")

    def quoted(c):
        c = F.coalesce(c, F.lit(""))
        wrapped = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        needs = F.lit(quote_all) | F.contains(c, F.lit(delimiter)) | c.rlike('["\\r\\n]')
        return F.when(needs, wrapped).otherwise(c)

    return F.concat_ws(delimiter, *(quoted(text(f)) for f in df.schema.fields))


def number_rows(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """With _n: 0, 1, ... in the order of the columns. Rows are range-partitioned and numbered within partitions."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    spread = cut(spread)  # its bounds are sampled: a second evaluation could deal rows otherwise
    first = spread.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_base"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    starts = first.select("_p", "_base", before.alias("_before"))
    return spread.join(F.broadcast(starts), "_p").withColumn("_n", F.col("_before") + F.col("_m") - F.col("_base")).drop("_p", "_m", "_base", "_before")


def copy_upload(spark: SparkSession, files: list[str], target: str, kms_key_id: str | None = None) -> list[str]:
    """Copy files to any Hadoop file system (``s3a://`` on a cluster), with KMS encryption if a key is named."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if kms_key_id:
        conf.set("fs.s3a.encryption.algorithm", "SSE-KMS")
        conf.set("fs.s3a.encryption.key", kms_key_id)
    out = []
    for f in files:
        source, dest = jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{Path(f).name}")
        if not jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, dest.getFileSystem(conf), dest, False, True, conf):
            raise UploadError(f"cannot copy {f} to {dest}")
        out.append(str(dest))
    return out


def send_mail(settings: dict, subject: str, text: str, attempts: int = 3, timeout: int = 30, pause: Callable[[float], None] = time.sleep) -> bool:
    """Send a notification; waits 1 s, then 2 s between attempts. Failure is reported, not raised."""
    if not settings.get("enabled"):
        return False
    message = EmailMessage()
    message["From"], message["To"] = settings["from_addr"], settings["to_addr"]
    message["Subject"] = f"{settings.get('subject_prefix', '')} {subject}".strip()
    message.set_content(text)
    for attempt in range(attempts):
        try:
            with smtplib.SMTP(settings["smtp_server"], int(settings.get("port", 25)), timeout=timeout) as server:
                if settings.get("use_tls"):
                    server.starttls()
                server.send_message(message)
            return True
        except OSError:
            if attempt + 1 < attempts:
                pause(2.0**attempt)
    return False


class Extract:
    """One run: read, write, upload, clean up; ``metrics`` holds seconds and counts."""

    def __init__(self, spark: SparkSession, config: Config, read: Callable[[SparkSession, Config], DataFrame] = jdbc_reader, upload=copy_upload, target: str | None = None, log: logging.Logger | None = None) -> None:
        self.spark, self.config, self.read, self.upload = spark, config, read, upload
        self.target = target or f"s3a://{config.s3['bucket']}/{str(config.s3.get('prefix') or '').strip('/')}"
        self.log, self.metrics = log or logging.getLogger("millrace.extract"), {}

    def _timed(self, name: str, error: type[ExtractError], function, *a):
        began = time.monotonic()
        try:
            return function(*a)
        except ExtractError:
            raise
        except Exception as e:
            raise error(str(e)) from e
        finally:
            self.metrics[f"{name}_seconds"] = time.monotonic() - began

    def run(self) -> list[str]:
        c = self.config
        df = self._timed("query", QueryError, self.read, self.spark, c)
        written = self._timed("write", CsvError, lambda: write_csv_files(df, c.output["local_dir"], c.output["base_filename"], c.records_per_file, **c.csv))
        files = [f["path"] for f in written]
        self.metrics |= {"files": len(files), "rows": sum(f["rows"] for f in written), "bytes": sum(f["bytes"] for f in written)}
        self.log.info("%s rows in %s files, %s, %s written", self.metrics["rows"], len(files), human_bytes(self.metrics["bytes"]), rate(self.metrics["rows"], self.metrics["write_seconds"]))
        if not files:
            self.log.warning("the query gave no rows; no file was written")
            return []
        sent = self._timed("upload", UploadError, self.upload, self.spark, files, self.target, c.s3.get("kms_key_id"))
        if c.cleanup_local:
            remove_files(files)
        self.log.info("%s files in %.1f s", len(sent), sum(v for k, v in self.metrics.items() if k.endswith("_seconds")))
        return sent


def file_logger(root: str, name: str, debug: bool = False) -> logging.Logger:
    """Logs to ``<root>/<name>.log``, with errors, critical errors and (if asked for) debug lines in files of their own."""
    log = logging.getLogger(f"millrace.{name}")
    log.setLevel(logging.DEBUG if debug else logging.INFO)
    log.handlers.clear()
    Path(root).mkdir(parents=True, exist_ok=True)
    levels = {"log": logging.INFO, "error": logging.ERROR, "critical": logging.CRITICAL} | ({"debug": logging.DEBUG} if debug else {})
    for suffix, level in levels.items():
        handler = logging.FileHandler(f"{root}/{name}.{suffix}")
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, **parts) -> int:
    """``[-v] [-d] config.yaml``; returns an exit code."""
    parser = argparse.ArgumentParser(prog="extract")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("-d", "--debug", action="store_true")
    parser.add_argument("config")
    options = parser.parse_args(arguments)
    notify: dict = {}
    try:
        config = load_config(options.config)
        notify = config.notifications
        if folder := config.logging.get("root_directory"):
            parts.setdefault("log", file_logger(folder, str(config.logging.get("process_name") or "extract"), options.debug or config.debug))
        if options.verbose:
            logging.getLogger("millrace").addHandler(logging.StreamHandler())
            logging.getLogger("millrace").setLevel(logging.INFO)
        if options.debug or config.debug:
            logging.getLogger("millrace.extract").debug("configuration: %s", redact(vars(config)))
        sent = Extract(spark or SparkSession.builder.getOrCreate(), config, **parts).run()
        send_mail(notify.get("on_success") or {}, "extract finished", "\n".join(sent))
        return EXIT_CODES["ok"]
    except KeyboardInterrupt:
        return EXIT_CODES["interrupt"]
    except ExtractError as e:
        code, text = EXIT_CODES[e.kind], f"{type(e).__name__}: {e}"
    except Exception as e:
        code, text = EXIT_CODES["unexpected"], f"{type(e).__name__}: {e}"
    logging.getLogger("millrace.extract").error(text)
    send_mail(notify.get("on_failure") or {}, "extract failed", text)
    return code


if __name__ == "__main__":
    sys.exit(main())
