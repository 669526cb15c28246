"""Settings of a run."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

from strandline import __version__

LEVELS = ("contig", "scaffold", "chromosome", "complete")
SOURCES = ("genbank", "refseq")


class Secret(str):
    """A string that does not show itself."""

    def __repr__(self) -> str:
        return "**********" if len(self) else ""


_INPUTS = {"tar_paths": "file", "neg_paths": "file", "tar_dir": "directory", "neg_dir": "directory"}
# What holds for an option, or for several together, and how to say that it does not.
_RULES = {
    "targets": (lambda c: c.download_only or c.tar_taxa or c.tar_paths or c.tar_dir, "one of tar_paths, tar_taxa and tar_dir is needed"),
    "non-targets": (lambda c: c.download_only or c.neg_taxa or c.neg_paths or c.neg_dir, "one of neg_paths, neg_taxa and neg_dir is needed"),
    "kmerlen": (lambda c: 1 <= c.kmerlen <= 255, "from 1 to 255"),
    "windowsize": (lambda c: c.windowsize >= 1, "at least 1"),
    "n_cpu": (lambda c: c.n_cpu >= 1, "at least 1"),
    "penalty_th": (lambda c: c.penalty_th is None or 0 <= c.penalty_th <= 1, "from 0 to 1"),
    "stringency": (lambda c: 0 <= c.stringency <= 10, "from 0 to 10"),
    "max_len": (lambda c: c.max_len is None or c.max_len > c.min_len, "greater than min_len"),
    "level": (lambda c: c.level in LEVELS, f"one of {', '.join(LEVELS)}"),
    "source": (lambda c: c.source in SOURCES, f"one of {', '.join(SOURCES)}"),
    "order": (lambda c: c.order in ("shuffle", "hash"), "shuffle or hash"),
}


def _existing(name: str, value: str | Path, kind: str) -> Path:
    p = Path(value).expanduser()
    if not (p.is_file() if kind == "file" else p.is_dir()):
        raise ValueError(f"{name}: {value} is no {kind}")
    return p.resolve()


@dataclass(frozen=True)
class Config:
    """Immutable and checked when made; paths are resolved and must exist."""

    # Names and defaults of the public options.
    tar_taxa: list[str] | None = None
    neg_taxa: list[str] | None = None
    tar_paths: Path | None = None
    neg_paths: Path | None = None
    tar_dir: Path | None = None
    neg_dir: Path | None = None

    prefix: Path = field(default_factory=Path.cwd)
    title: str = "strandline-out"
    overwrite: bool = False

    kmerlen: int = 21
    windowsize: int = 200
    penalty_th: float | None = None
    run_mash: bool = True
    stringency: int = 5
    min_len: int = 200
    max_len: int | None = None
    run_blast: bool = True
    blast_neg_only: bool = False

    penalty_th_cap: float = 0.2
    edge_w_th_mul: float = 0.3
    min_nodes_floor: int = 3
    max_nodes_cap: int | None = 100
    sketchsize: int = 1000

    level: str = "contig"
    source: str = "genbank"
    annotated: bool = False
    exclude_mag: bool = False
    gzip: bool = True
    api_key: str | None = None
    download_only: bool = False
    save_graph: bool = False

    seed: int = 42
    n_cpu: int = 4
    low_memory: bool = False

    # options of this engine: the order of seeds (``hash`` collects none of them), and where Parquet tables go
    order: str = "shuffle"
    tables: str | None = None

    def __post_init__(self) -> None:
        for name, (right, message) in _RULES.items():
            if not right(self):
                raise ValueError(f"{name}: {message}")
        for name, kind in _INPUTS.items():
            if getattr(self, name) is not None:
                object.__setattr__(self, name, _existing(name, getattr(self, name), kind))
        object.__setattr__(self, "prefix", Path(self.prefix))
        if self.api_key is not None:
            object.__setattr__(self, "api_key", Secret(self.api_key))

    def to_dict(self) -> dict:
        """For config.json: with the version, without the key."""
        d = asdict(self)
        d["api_key"] = None if self.api_key is None else "**********"
        return {k: str(v) if isinstance(v, Path) else v for k, v in d.items()} | {"version": __version__}
