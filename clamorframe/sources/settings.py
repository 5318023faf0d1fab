"""What a run is asked for: its track, how answers are judged, and where models are, from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..operators.audio import SLOT_SNR, SLOT_SNR_DISJOINT
from ..operators.probe import ANSWER_BATCH, BATCH
from ..operators.score import KINDS, MATRICES

# By track the variable that asks for it, draws a round, witnesses, and how its evaluation is judged.
TRACKS = {
    "heard-reply": {"variable": "HR", "batch": 16, "witnesses": 1, "heard": True},
    "tree": {"variable": "TREE", "batch": 16, "witnesses": 2, "matrix": "tree", "restate": True},
    "beam": {"variable": "BEAM", "batch": 4, "witnesses": 1, "per_kind": True},
    "sent-2": {"variable": "SENT2", "batch": 16, "witnesses": 2, "per_kind": True, "restate": True},
    "sent-4": {"variable": "SENT4", "batch": 4, "witnesses": 4, "per_kind": True},
    "two-kinds": {"variable": "CR", "batch": 16, "witnesses": 2, "per_kind": True, "kinds": ["answer", "repair"]},
    "two-pass": {"variable": None, "batch": 16, "witnesses": 2},
}
PORT = 8000
# End of fixed values.


@dataclass(frozen=True)
class Settings:
    track: str = "two-pass"
    batch: int = BATCH
    answer_batch: int = ANSWER_BATCH
    witnesses: int = 2
    matrix: str = "legacy"
    per_kind: bool = False
    heard: bool = False
    restate: bool = False
    kinds: list[str] = field(default_factory=lambda: list(KINDS))
    host: str | None = None

    @property
    def bands(self) -> dict[str, tuple[float, float]]:
        """Levels of each kind: they overlap on the two-pass track alone."""
        return SLOT_SNR if self.track == "two-pass" else SLOT_SNR_DISJOINT

    @property
    def base_url(self) -> str | None:
        return None if self.host is None else f"http://{self.host}:{PORT}/v1"


def settings(given: Mapping[str, str], host: str | None = None) -> Settings:
    """The track whose variable is set and not empty, two-pass without one; KINDS and SCORE_MATRIX override it. ValueError for two tracks or unknown values."""
    asked = [t for t, x in TRACKS.items() if x["variable"] and given.get(x["variable"])]
    if len(asked) > 1:
        raise ValueError(f"one track at a time, not {asked}")
    track = asked[0] if asked else "two-pass"
    found = {k: v for k, v in TRACKS[track].items() if k != "variable"}
    if given.get("KINDS"):
        found["kinds"] = [k.strip() for k in given["KINDS"].split(",")]
    if given.get("SCORE_MATRIX"):
        found["matrix"] = given["SCORE_MATRIX"]
    out = Settings(track=track, host=host, **found)
    if not out.kinds or set(out.kinds) - set(KINDS):
        raise ValueError(f"kinds {out.kinds}; they are {KINDS}")
    if out.matrix not in MATRICES:
        raise ValueError(f"matrix {out.matrix!r}; they are {list(MATRICES)}")
    return out


def host_from(spark: SparkSession, path: str) -> str:
    """The host that a file names on its first line that is not blank, in any store that Spark reads."""
    for row in spark.read.text(path).toLocalIterator():
        if row["value"].strip():
            return row["value"].strip()
    raise ValueError(f"{path} names no host")
