"""What surrounds a job: the command line, signed links, and logs and errors without anybody's data."""

from __future__ import annotations

import argparse
import hashlib
import hmac
import logging
import platform
import sys
import time
from collections.abc import Sequence

#: Fields that a log line may have, and the types they may be of.
FIELDS = {"job": str, "stage": str, "documents": int, "released": int, "quarantined": int, "seconds": float, "profile": str, "style": str, "code": str}
DONE, FAILED, QUARANTINED = 0, 1, 2


class CodeError(Exception):
    """An error that says its code and nothing else; it stays one when it is sent between processes."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code

    def __reduce__(self):
        return CodeError, (self.code,)


def sanitised(error: BaseException) -> str:
    """An error's class and where it was raised, without its message."""
    at = error.__traceback__
    while at is not None and at.tb_next is not None:
        at = at.tb_next
    where = f"{at.tb_frame.f_code.co_name}:{at.tb_lineno}" if at is not None else "-"
    return f"{error.code if isinstance(error, CodeError) else type(error).__name__} {where}"


class PlainFormatter(logging.Formatter):
    """Only known fields of known types; a message of others is told by its length and hash."""

    def format(self, record: logging.LogRecord) -> str:
        fields = getattr(record, "fields", None)
        if fields is None:
            text = record.getMessage().encode()
            return f"{record.levelname} foreign length={len(text)} sha256={hashlib.sha256(text).hexdigest()[:16]}"
        shown = [f"{k}={v}" for k, v in fields.items() if k in FIELDS and type(v) is FIELDS[k] and "\n" not in str(v)]
        return " ".join([record.levelname, record.name, *shown])


def log(logger: logging.Logger, **fields) -> None:
    logger.info("", extra={"fields": fields})


def plain_logs() -> None:
    """All logs of this process, ours and others', in the plain form."""
    handler = logging.StreamHandler()
    handler.setFormatter(PlainFormatter())
    logging.basicConfig(level=logging.INFO, handlers=[handler], force=True)


def signed(key: bytes, purpose: str, job: str, name: str, until: int) -> str:
    """A token for one file of one job, good until a time."""
    message = "\x1f".join((purpose, job, name, str(until))).encode()
    return f"{until}.{hmac.new(key, message, hashlib.sha256).hexdigest()}"


def verified(key: bytes, purpose: str, job: str, name: str, token: str, now: int | None = None) -> bool:
    until = token.partition(".")[0]
    if not until.isdigit() or int(until) < (time.time() if now is None else now):
        return False
    return hmac.compare_digest(token, signed(key, purpose, job, name, int(until)))


def runtime() -> dict[str, str]:
    """What a result may depend on besides its input."""
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "machine": platform.machine()}


def run(arguments: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .plans.flow import deidentify
    from .session import session

    spark = session(arguments.master, checkpoints=arguments.checkpoints)
    seeds = [tuple(s.split("=", 1)) for s in arguments.seed]
    out = deidentify(spark.read.parquet(arguments.input), arguments.profile, arguments.style, seeds=seeds)
    released = out["gate"].where("outcome = 'released'").select("doc_id")
    out["output"].join(released, "doc_id", "left_semi").write.mode("overwrite").parquet(f"{arguments.output}/released")
    out["gate"].where("outcome <> 'released'").write.mode("overwrite").json(f"{arguments.output}/quarantined")
    ends = {r["outcome"]: r["n"] for r in out["gate"].groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    log(logging.getLogger("veilframe"), documents=sum(ends.values()), released=ends.get("released", 0), quarantined=ends.get("quarantined", 0), profile=arguments.profile, style=arguments.style)
    return QUARANTINED if ends.get("quarantined") else DONE


def profiles(arguments: argparse.Namespace) -> int:
    from .operators.policy import PROFILES

    print("\n".join(PROFILES))
    return DONE


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilframe")
    commands = parser.add_subparsers(dest="command", required=True)
    job = commands.add_parser("run", help="de-identify a Parquet table of doc_id and text")
    job.add_argument("input")
    job.add_argument("output")
    job.add_argument("--profile", default="broad", choices=("broad", "client", "claimant_focused", "maximal"))
    job.add_argument("--style", default="label", choices=("label", "surrogate", "blackout"))
    job.add_argument("--seed", action="append", default=[], metavar="TYPE=VALUE")
    job.add_argument("--master")
    job.add_argument("--checkpoints", help="a folder that all nodes share")
    job.set_defaults(call=run)
    commands.add_parser("profiles").set_defaults(call=profiles)
    arguments = parser.parse_args(argv)
    try:
        return arguments.call(arguments)
    except Exception as error:  # no message of it may reach a log
        print(sanitised(error), file=sys.stderr)
        return FAILED
