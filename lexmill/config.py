"""Settings: formatting options and their presets, templates, limits.  Plain values, sent with the plans."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Formatting:
    """Fonts, sizes (pt), indents (characters), margins (cm) and the grid of a formatted document."""

    scheme_name: str = "公文格式（基础）"
    title_font: str = "方正小标宋简体"
    title_size: float = 22.0
    title_bold: bool = True
    body_font: str = "仿宋_GB2312"
    body_size: float = 16.0
    heading_fonts: tuple[str, str, str, str] = ("黑体", "楷体_GB2312", "仿宋_GB2312", "仿宋_GB2312")
    heading_sizes: tuple[float, float, float, float] = (16.0, 16.0, 16.0, 16.0)
    heading_bolds: tuple[bool, bool, bool, bool] = (False, False, False, False)
    heading_indents: tuple[float, float, float, float] = (2.0, 2.0, 2.0, 2.0)
    code_font: str = "Consolas"
    code_size: float = 10.5
    emphasis_font: str = "黑体"
    emphasis_size: float = 0.0
    line_spacing: float = 28.0
    char_spacing: float = 0.0
    first_indent: float = 2.0
    margin_top: float = 3.7
    margin_bottom: float = 3.5
    margin_left: float = 2.8
    margin_right: float = 2.6
    page_number_font: str = "宋体"
    page_number_size: float = 14.0
    page_number_alignment: str = "alternate"
    lines_per_page: int = 22
    chars_per_line: int = 28
    before_spacing: float = 0.0
    after_spacing: float = 0.0

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Formatting | None:
        """None if the text can't be read as options."""
        try:
            known = {f.name for f in fields(cls)}
            return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known})
        except (ValueError, TypeError, AttributeError):
            return None


#: A profile's fields, and where the options have them (a name, or a name and a place).
PROFILE_FIELDS: dict[str, tuple[str, int | None]] = {
    "titleFont": ("title_font", None),
    "headingFont": ("heading_fonts", 0),
    "subheadingFont": ("heading_fonts", 1),
    "bodyFont": ("body_font", None),
    "codeBlockFont": ("code_font", None),
    "titleFontSizePt": ("title_size", None),
    "headingFontSizePt": ("heading_sizes", 0),
    "subheadingFontSizePt": ("heading_sizes", 1),
    "bodyFontSizePt": ("body_size", None),
    "codeBlockFontSizePt": ("code_size", None),
    "lineSpacingPt": ("line_spacing", None),
    "firstLineIndentChars": ("first_indent", None),
    "beforeSpacingPt": ("before_spacing", None),
    "afterSpacingPt": ("after_spacing", None),
    "pageMarginTopCm": ("margin_top", None),
    "pageMarginBottomCm": ("margin_bottom", None),
    "pageMarginLeftCm": ("margin_left", None),
    "pageMarginRightCm": ("margin_right", None),
}
CUSTOM = "自定义"


def extracted(options: Formatting) -> dict[str, str | float]:
    """The fields of a profile, from options."""
    return {k: getattr(options, name) if at is None else getattr(options, name)[at] for k, (name, at) in PROFILE_FIELDS.items()}


def applied(profile: dict, options: Formatting) -> Formatting:
    """``options`` with what a profile's fields say; other keys and nulls change nothing."""
    for k, (name, at) in PROFILE_FIELDS.items():
        if profile.get(k) is not None:
            held = getattr(options, name)
            kind = type(held if at is None else held[at])
            value = kind(profile[k])
            options = replace(options, **{name: value if at is None else (*held[:at], value, *held[at + 1 :])})
    return options


def profile_json(options: Formatting, name: str = CUSTOM) -> str:
    return json.dumps({"name": name, "isBuiltIn": False, "options": extracted(options)}, ensure_ascii=False, indent=2)


def load_profile(text: str | None) -> tuple[str, dict] | None:
    """(name, fields) of a profile's JSON; None if it can't be read.  One without a name is a custom one."""
    try:
        held = json.loads(text or "")
        name, options = held.get("name"), held.get("options") or {}
        applied(options, Formatting())
        return (name if isinstance(name, str) and name.strip() else CUSTOM), {k: options[k] for k in PROFILE_FIELDS if options.get(k) is not None}
    except (ValueError, TypeError, AttributeError):
        return None


OFFICIAL = Formatting()
ENTERPRISE = replace(
    OFFICIAL,
    scheme_name="企业增强版",
    title_size=24.0,
    body_font="方正仿宋简体",
    body_size=18.0,
    heading_fonts=("方正黑体简体", "方正楷体简体", "方正仿宋简体", "方正仿宋简体"),
    heading_sizes=(18.0, 18.0, 18.0, 18.0),
    emphasis_font="方正黑体简体",
    emphasis_size=18.0,
    line_spacing=31.0,
    char_spacing=0.4,
    margin_top=3.2,
    margin_bottom=3.2,
    margin_left=2.5,
    margin_right=2.5,
    page_number_alignment="center",
    lines_per_page=21,
    chars_per_line=24,
)
GENERAL = replace(OFFICIAL, scheme_name="普通文档", margin_top=2.54, margin_bottom=2.54, margin_left=2.54, margin_right=2.54)
ACADEMIC = replace(OFFICIAL, scheme_name="学术论文格式", title_font="黑体", body_font="宋体", body_size=12.0, heading_fonts=("黑体", "黑体", "黑体", "黑体"), line_spacing=18.0)
PRESETS = {p.scheme_name: p for p in (OFFICIAL, ENTERPRISE, GENERAL, ACADEMIC)}

#: The built-in templates; one more name for the first.
TEMPLATES = {"official-report": OFFICIAL, "meeting-minutes": OFFICIAL}
ALIASES = {"official-basic": "official-report"}


def template(name: str | None) -> tuple[str, Formatting]:
    """(id, options), whatever the id's case; unknown ids give the default."""
    key = (name or "").strip().lower()
    key = ALIASES.get(key, key)
    return (key, TEMPLATES[key]) if key in TEMPLATES else ("official-report", OFFICIAL)


@dataclass(frozen=True)
class Limits:
    """Batch and security settings."""

    allowed_directories: tuple[str, ...] = ()
    allowed_types: tuple[str, ...] = ()
    max_bytes: int = 0
    allow_overwrite: bool = False
    isolate_output: bool = True
    continue_on_error: bool = True
    scan_limit: int = 5000
    package_mode: str = "SingleMd"
    converter: str = "lexmill"
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Limits:
        """Settings of a JSON file; what is missing or out of range takes its default."""
        try:
            raw = json.loads(Path(path).read_text("utf-8"))
        except (OSError, ValueError):
            return cls()
        known = {f.name for f in fields(cls)}
        made = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known})
        bad_mode = made.package_mode not in ("SingleMd", "HybridPackage")
        return replace(made, scan_limit=made.scan_limit if made.scan_limit > 0 else 5000, max_bytes=max(0, made.max_bytes), package_mode="SingleMd" if bad_mode else made.package_mode)
