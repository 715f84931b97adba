"""Options of the text operators and the normalisers of their names."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ShortHeading:
    max_len: int = 8
    all_ascii: bool = True
    all_cjk: bool = True
    all_ascii_digits: bool = True
    mixed: bool = True
    custom_regex: str = ""

    def custom(self) -> str | None:
        """The user's title pattern; None where it is blank or the engine that runs it takes it for none."""
        return self.custom_regex if self.custom_regex.strip() and is_pattern(self.custom_regex) else None


def is_pattern(rx: str) -> bool:
    """Whether Java, which evaluates patterns in columns, can compile one; Python's own dialect differs in both directions."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("a Spark session is needed to check a pattern")
    try:
        session._jvm.java.util.regex.Pattern.compile(rx)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


@dataclass(frozen=True)
class PdfOptions:
    add_page_header: bool = False
    compact: bool = False
    auto_reflow: bool = True
    normalize_compat: bool = True
    ignore_untrusted: bool = False
    engine: int = 2
    short_heading: ShortHeading = field(default_factory=ShortHeading)

    def as_row(self) -> dict:
        return asdict(self)


def boundary_level(level: int) -> int:
    """Sentence-boundary level, clamped to 1..3."""
    return min(3, max(1, level))


#: Platforms that have the native engine.
NATIVE_PLATFORMS = ("win-x64", "linux-x64", "osx-x64", "osx-arm64", "win-x86")


def pdf_engine(engine: int, platform: str) -> int:
    """1 (managed) where asked for or where the platform lacks the native engine, else 2."""
    return 2 if engine == 2 and platform in NATIVE_PLATFORMS else 1


def engine_name(engine: int) -> str:
    return "native" if engine == 2 else "managed"


def check_batch(paths: list[str], folder_exists: bool, direction: str | None) -> None:
    """What a batch needs before it starts."""
    for missing, what in ((not paths, "files"), (not folder_exists, "an output folder"), (not direction, "a direction")):
        if missing:
            raise ValueError(f"the batch needs {what}")


def detofu_level(label: str | None, prefixed: bool = True) -> str:
    """ExtB .. ExtI from a label; ``prefixed`` also reads the EXT-B form.  Anything else is ExtB."""
    s = (label or "").strip().upper()
    m = re.fullmatch(r"EXT-?([B-I])" if prefixed else r"EXT([B-I])", s)
    return "Ext" + (m[1] if m else "B")


def config_key(label: str) -> str:
    """What stands before the first space."""
    return label.split(" ", 1)[0]


def merge(default: dict, user: dict) -> dict:
    """Settings of ``user`` over ``default``: objects are merged, all else (lists too) is replaced."""
    out = dict(default)
    for k, v in user.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def difference(default: dict, now: dict) -> dict:
    """What of ``now`` differs from ``default``: the smallest overlay that ``merge`` turns back into it."""
    out = {}
    for k, v in now.items():
        if isinstance(v, dict) and isinstance(default.get(k), dict):
            if inner := difference(default[k], v):
                out[k] = inner
        elif k not in default or default[k] != v:
            out[k] = v
    return out
