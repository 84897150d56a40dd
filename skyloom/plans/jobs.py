"""Jobs from sessions: which lights and masters each external port of a template gets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import dag

#: Settings that the sessions of one job must share.
SHARED = ("instrument", "exptime", "gain", "binning")
#: Lights that a stack needs.
LEAST_LIGHTS = 3
KINDS = ("dark", "flat", "bias")


class JobError(ValueError):
    """Sessions from which no job can be made."""


@dataclass(frozen=True)
class Port:
    node: str
    port: str
    what: str  # lights, or the kind of a master
    many: bool
    optional: bool


def external_ports(t: dag.Template, per_session: bool) -> list[Port]:
    """The ports that sessions feed: by convention ``lights``, and masters by their kind."""
    out = []
    for n in t.nodes:
        if per_session and not n.per_session:
            continue
        kind = dag.KINDS[n.kind]
        for port, want in kind.inputs.items():
            refs = n.inputs.get(port, ())
            if any(src != "input" for src, _ in refs):
                continue
            optional = port in kind.optional
            if want == "sequence" and port == "lights":
                out.append(Port(n.id, port, "lights", False, False))
            elif want in ("master", "masters") and port in KINDS:
                out.append(Port(n.id, port, port, want == "masters", optional))
    return out


def check_compatible(sessions: DataFrame) -> None:
    """All sessions share their settings; spellings of an instrument count as one."""
    value = lambda c: text.canonical_instrument(F.col(c)) if c == "instrument" else F.col(c)
    said = sessions.agg(*(F.array_sort(F.collect_set(value(c).cast("string"))).alias(c) for c in SHARED), *(F.count_if(F.col(c).isNull()).alias(f"{c}_none") for c in SHARED), F.count(F.lit(1)).alias("n")).first()
    bad = [f"{c}: {', '.join(said[c]) or 'none'}" for c in SHARED if len(said[c]) + (0 < said[f"{c}_none"] < said["n"]) > 1 or (said[f"{c}_none"] and said[c])]
    if bad:
        raise JobError("sessions differ in " + "; ".join(bad))


def inputs(t: dag.Template, sessions: DataFrame, lights: DataFrame, matches: DataFrame, *, mode: str = "matched", explicit: Mapping[str, str] | None = None) -> DataFrame:
    """``key, source`` of a job's external inputs.

    ``sessions`` has ``session`` and the settings, ``lights`` a row for each light
    frame (``session, quality, rescued``), ``matches`` the masters matched to
    sessions (``session, kind, path``).  Repeated sessions count once.  With nodes
    per session each session gets the inputs of its own copies, and one too short to
    stack adds nothing; else the sessions are one bundle, with the first one's
    masters and all darks.  ``mode`` none leaves masters out, explicit takes the
    paths of ``explicit`` where it has them.
    """
    sessions = sessions.dropDuplicates(["session"])
    check_compatible(sessions)
    wide = any(n.per_session for n in t.nodes)
    good = (F.coalesce(F.col("quality"), F.lit("")) != "failed") | F.coalesce(F.col("rescued"), F.lit(False))
    counts = lights.filter(good).groupBy("session").agg(F.count(F.lit(1)).alias("lights"))
    own = sessions.select("session").join(counts, "session", "left").select("session", F.coalesce("lights", F.lit(0)).alias("lights"))
    if wide:
        own = own.filter(F.col("lights") >= LEAST_LIGHTS)
        if own.isEmpty():
            raise JobError(f"no session has {LEAST_LIGHTS} lights to stack")
    elif (own.agg(F.sum("lights")).first()[0] or 0) < LEAST_LIGHTS:
        raise JobError(f"the sessions have fewer than {LEAST_LIGHTS} lights between them")
    first = own.agg(F.min("session")).first()[0]
    name = F.col("session").cast("string")
    out: DataFrame | None = None
    for p in external_ports(t, wide):
        key = F.concat(F.lit(f"{p.node}@"), name, F.lit(f".{p.port}")) if wide else F.lit(f"{p.node}.{p.port}")
        if p.what == "lights":
            if wide:
                rows = own.select(key.alias("key"), F.concat(F.lit("lights/"), name).alias("source"))
            else:  # one folder for the bundle, named by its sessions
                rows = own.agg(F.concat_ws(",", F.array_sort(F.collect_set("session")).cast("array<string>")).alias("s")).select(key.alias("key"), F.concat(F.lit("lights/"), F.sha2("s", 256)).alias("source"))
        elif mode == "none" or (mode == "explicit" and p.what in (explicit or {})):
            rows = own.select(key.alias("key"), F.lit((explicit or {}).get(p.what)).alias("source")).distinct() if mode == "explicit" else None
        else:
            found = matches.filter(F.col("kind") == p.what).join(own.select("session"), "session", "left_semi")
            found = found if wide or p.many else found.filter(F.col("session") == first)
            rows = found.select(key.alias("key"), F.col("path").alias("source")).distinct()
        if not p.optional and (rows is None or rows.isEmpty()):
            raise JobError(f"{p.node}.{p.port}: no master {p.what}")
        if rows is not None:
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise JobError(f"template {t.name} has no port that sessions feed")
    return out
