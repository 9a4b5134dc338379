"""Configuration: one .ini file, every key typed and known, refused where it is ambiguous.

``load`` reads, types, derives and validates; the result is frozen and all of it is known before a
plan is built, so plans hold only the branches that were chosen.
"""

from __future__ import annotations

import configparser
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

from . import constants as K
from .errors import ConfigError

SERIES = ("u", "v", "w", "ts", "ta", "p_air", "co2", "h2o", "t_cell", "p_cell")
GASES = ("co2", "h2o")
#: State of the analyser's cell: used to convert densities, never a signal of its own.
CELL = ("t_cell", "p_cell")

#: Sections, keys, kinds and defaults. Tuples are choices; None means not set.
KEYS: dict[str, dict[str, tuple[object, object]]] = {
    "files": {
        "input_glob": ("str", "./*.dat"), "output_csv": ("str", ...), "header_line": ("int", 1), "first_data_line": ("int", 2), "delimiter": ("char", ","),
        "quotechar": ("char", '"'), "na_values": ("tokens", ("-9999", "NAN", "NaN", "nan", "")), "encoding": ("str", "utf-8-sig"),
    },
    "runtime": {"use_numpy": (("auto", "true", "false"), "auto"), "log_level": (("DEBUG", "INFO", "WARNING", "ERROR"), "INFO")},
    "site": {
        "site_id": ("str", "XX-Xxx"), "latitude": ("float", 0.0), "measurement_height": ("float", 3.0), "canopy_height": ("float", 0.0),
        "displacement_height": ("float", None), "north_offset": ("float", 0.0), "pressure_pa": ("float", None),
    },
    "period": {"averaging_minutes": ("float", 30.0), "closed": (("right", "left"), "right"), "acquisition_frequency": ("float", 20.0), "min_samples": ("int", 0), "equal_stamps": (("drop", "keep"), "drop")},
    "timestamp": {"column": ("str", "TIMESTAMP"), "format": (("iso", "numeric"), "iso")},
    "variables": {
        "u": ("str", "Ux"), "v": ("str", "Uy"), "w": ("str", "Uz"), "ts": ("str", "Ts"), "co2": ("str", "CO2"), "h2o": ("str", "H2O"),
        "ta": ("str", None), "p_air": ("str", "Press"), "t_cell": ("str", None), "p_cell": ("str", None),
    },
    "units": {
        "ts": (("K", "degC"), "K"), "ta": (("K", "degC"), "K"), "p_air": (("Pa", "hPa", "kPa"), "Pa"), "t_cell": (("K", "degC"), "degC"),
        "p_cell": (("Pa", "hPa", "kPa"), "kPa"),
        "co2": (("ppm", "umol/mol", "ppt", "mmol/mol", "mmol/m3", "mol/m3", "mg/m3", "g/m3"), "ppm"),
        "h2o": (("ppm", "umol/mol", "ppt", "mmol/mol", "mmol/m3", "mol/m3", "mg/m3", "g/m3"), "ppt"),
    },
    "gases": {"co2_measure_type": (("mixing_ratio", "molar_density"), "mixing_ratio"), "h2o_measure_type": (("mixing_ratio", "molar_density"), "mixing_ratio"), "analyser_path": (("open", "closed"), "open")},
    "despike": {"enabled": ("bool", True), "variables": ("names", ("u", "v", "w", "ts", "co2", "h2o")), "q": ("float", 7.0)},
    "rotate": {"method": (("double", "none"), "double")},
    "lag": {"method": (("covmax_default", "covmax", "fixed", "none"), "covmax_default"), "scalars": ("names", ("co2", "h2o"))},
    "detrend": {"method": (("block", "linear"), "block"), "variables": ("names", ("u", "v", "w", "ts", "co2", "h2o"))},
    "wpl": {"enabled": (("auto", "on", "off"), "auto")},
    "spectral": {"enabled": ("bool", False), "co2_tau_s": ("float", None), "h2o_tau_s": ("float", None)},
    "qc": {"steady_state_pair": ("names", ("w", "co2")), "itc": ("bool", True)},
    "output": {"na_value": ("str", "-9999"), "float_format": ("str", "%.6g")},
}
LAG_DEFAULTS = {"nominal_s": 0.0, "min_s": -2.0, "max_s": 2.0}
#: Keys that may be written and left empty, which means not set.
MAY_BE_BLANK = {("site", "displacement_height"), ("site", "pressure_pa"), ("variables", "ta"), ("variables", "p_air"), ("variables", "t_cell"), ("variables", "p_cell"), ("spectral", "co2_tau_s"), ("spectral", "h2o_tau_s")}
#: Affine maps to the engine's units: factor, offset; molar masses divide what is weighed.
TEMPERATURE = {"K": (1.0, 0.0), "degC": (1.0, K.T0)}
PRESSURE = {"Pa": (1.0, 0.0), "hPa": (100.0, 0.0), "kPa": (1000.0, 0.0)}
RATIO = {"ppm": 1e-6, "umol/mol": 1e-6, "ppt": 1e-3, "mmol/mol": 1e-3}
DENSITY = {"mmol/m3": 1e-3, "mol/m3": 1.0}
MASS = {"mg/m3": 1e-6, "g/m3": 1e-3}
MOLAR_MASS = {"co2": K.MCO2, "h2o": K.MV}
_BOOLS = {"true": True, "yes": True, "on": True, "1": True, "false": False, "no": False, "off": False, "0": False}


@dataclass(frozen=True)
class Window:
    """A lag window in seconds and, once the frequency is known, in samples."""

    nominal_s: float
    min_s: float
    max_s: float
    nominal: int = 0
    low: int = 0
    high: int = 0

    @property
    def configured(self) -> bool:
        return not (self.min_s == 0.0 and self.max_s == 0.0)


@dataclass(frozen=True)
class Config:
    """Typed sections by name, and what follows from them."""

    sections: dict[str, SimpleNamespace]
    reported: dict[str, str]
    effective: dict[str, str]
    convert_cell: tuple[str, ...]
    maps: dict[str, tuple[float, float]]
    window_us: int
    displacement: float
    lags: dict[str, Window]
    warnings: tuple[str, ...] = field(default=())

    def __getattr__(self, name: str) -> SimpleNamespace:
        try:
            return self.__dict__["sections"][name]
        except KeyError:
            raise AttributeError(name) from None

    def density(self, gas: str) -> bool:
        """Whether a gas is a density after cell conversion."""
        return self.effective[gas] == "molar_density"

    @property
    def height(self) -> float:
        return self.site.measurement_height - max(K.Z_MINUS_D_FLOOR, self.displacement)


def default(**changes: object) -> Config:
    """The defaults, with changes given as ``section__key=value``; values as in a file or typed."""
    raw: dict[str, dict[str, str]] = {"files": {"output_csv": "out.csv"}}
    for name, value in changes.items():
        section, _, key = name.partition("__")
        if isinstance(value, (tuple, list)):
            value = ",".join(map(str, value))
        raw.setdefault(section, {})[key] = "" if value is None else str(value)
    return build(raw)


def load(path: str) -> Config:
    """The configuration in a file; any doubt is a ConfigError."""
    parser = configparser.ConfigParser(interpolation=None, inline_comment_prefixes=("#", ";"), comment_prefixes=("#", ";"))
    parser.optionxform = str
    try:
        with open(path, encoding="utf-8") as f:
            parser.read_file(f)
    except (OSError, UnicodeDecodeError, configparser.Error) as e:
        raise ConfigError(f"{path}: {e}") from e
    if parser.defaults():
        raise ConfigError("a [DEFAULT] section is not supported")
    return build({s: dict(parser.items(s, raw=True)) for s in parser.sections()})


def build(raw: dict[str, dict[str, str]]) -> Config:
    typed = _bind(raw)
    cfg = _derive(typed)
    _validate(cfg)
    return cfg


def _bind(raw: dict[str, dict[str, str]]) -> dict[str, SimpleNamespace]:
    for section, keys in raw.items():
        if section not in KEYS:
            raise ConfigError(f"unknown section [{section}]; known are {', '.join(KEYS)}")
        for key in keys:
            if key not in KEYS[section] and not (section == "lag" and _lag_key(key)):
                raise ConfigError(f"unknown key {section}.{key}")
    out = {}
    for section, keys in KEYS.items():
        given = raw.get(section, {})
        values = {}
        for key, (kind, standard) in keys.items():
            if key not in given:
                if standard is ...:
                    raise ConfigError(f"{section}.{key} is required")
                values[key] = standard
            elif not given[key].strip() and kind != "tokens":
                if (section, key) not in MAY_BE_BLANK:
                    raise ConfigError(f"{section}.{key} is empty; leave it out for the default")
                values[key] = None
            else:
                values[key] = _coerce(f"{section}.{key}", kind, given[key])
        out[section] = SimpleNamespace(**values)
    windows = {}
    for scalar in out["lag"].scalars:
        parts = {}
        for name, standard in LAG_DEFAULTS.items():
            text = raw.get("lag", {}).get(f"{scalar}_{name}")
            if text is not None and not text.strip():
                raise ConfigError(f"lag.{scalar}_{name} is empty; leave it out for the default")
            parts[name] = standard if text is None else _coerce(f"lag.{scalar}_{name}", "float", text)
        windows[scalar] = parts
    out["lag"].windows = windows
    return out


def _lag_key(key: str) -> bool:
    return any(key == f"{s}_{n}" for s in SERIES for n in LAG_DEFAULTS)


def _number(name: str, value: str, of: Callable[[str], float], what: str) -> float:
    try:
        number = of(value)
    except ValueError:
        raise ConfigError(f"{name} is {value!r}, not {what}") from None
    if not math.isfinite(number):
        raise ConfigError(f"{name} is not finite")
    return number


def _choice(name: str, value: str, choices: tuple[str, ...]) -> str:
    by_lower = {c.lower(): c for c in choices}
    if value.lower() not in by_lower:
        raise ConfigError(f"{name} is {value!r}; choose one of {', '.join(choices)}")
    return by_lower[value.lower()]


def _flag(name: str, value: str) -> bool:
    if value.lower() not in _BOOLS:
        raise ConfigError(f"{name} is {value!r}; it is true or false")
    return _BOOLS[value.lower()]


def _char(name: str, value: str) -> str:
    plain = {"\\t": "\t", "\\;": ";", "\\#": "#"}.get(value, value)
    if len(plain) != 1:
        raise ConfigError(f"{name} is {value!r}, not one character")
    return plain


#: What reads a value of each kind, from the key's name and the stripped text.
PARSERS: dict[str, Callable[[str, str], object]] = {
    "int": lambda name, value: _number(name, value, int, "a whole number"),
    "float": lambda name, value: _number(name, value, float, "a number"),
    "bool": _flag,
    "char": _char,
    "names": lambda _, value: tuple(x.strip() for x in value.split(",") if x.strip()),
    "tokens": lambda _, value: tuple(x.strip() for x in value.split(",")),
}


def _coerce(name: str, kind: object, text: str) -> object:
    """A kind is a tuple of choices or the name of a parser; any other kind leaves the text as it is."""
    if isinstance(kind, tuple):
        return _choice(name, text.strip(), kind)
    return PARSERS.get(kind, lambda _, value: value)(name, text.strip())


def _derive(s: dict[str, SimpleNamespace]) -> Config:
    warnings = []
    reported = {g: getattr(s["gases"], f"{g}_measure_type") for g in GASES}
    closed = s["gases"].analyser_path == "closed"
    convert = tuple(g for g in GASES if closed and reported[g] == "molar_density")
    effective = {g: "mixing_ratio" if g in convert else reported[g] for g in GASES}
    maps = {n: (TEMPERATURE if n[0] == "t" else PRESSURE)[getattr(s["units"], n)] for n in ("ts", "ta", "t_cell", "p_air", "p_cell")}
    for gas in GASES:
        unit = getattr(s["units"], gas)
        if reported[gas] == "mixing_ratio":
            if unit not in RATIO:
                raise ConfigError(f"units.{gas} is {unit}, but {gas} is declared a mixing ratio")
            maps[gas] = (RATIO[unit], 0.0)
        elif unit in DENSITY:
            maps[gas] = (DENSITY[unit], 0.0)
        elif unit in MASS:
            maps[gas] = (MASS[unit] / MOLAR_MASS[gas], 0.0)
        else:
            raise ConfigError(f"units.{gas} is {unit}, but {gas} is declared a molar density")
    minutes, f = s["period"].averaging_minutes, s["period"].acquisition_frequency
    if minutes <= 0 or abs(minutes - round(minutes)) > 1e-9:
        raise ConfigError("period.averaging_minutes must be a positive whole number")
    if f <= 0:
        raise ConfigError("period.acquisition_frequency must be positive")
    site = s["site"]
    if site.displacement_height is not None and site.displacement_height > 0:
        displacement = site.displacement_height
    elif site.canopy_height > 0:
        displacement = K.CANOPY_DISPLACEMENT_RATIO * site.canopy_height
    else:
        displacement = 0.0
        warnings.append("neither site.displacement_height nor site.canopy_height is positive; displacement is 0")
    cell = [n for n in CELL if getattr(s["variables"], n) is not None]
    if cell and not convert:
        warnings.append(f"{' and '.join(f'variables.{n}' for n in cell)}: no closed-path density is declared, so the cell's state is not used")
    lags = {}
    for scalar, w in s["lag"].windows.items():
        if w["min_s"] > w["max_s"]:
            raise ConfigError(f"lag.{scalar}_min_s is above lag.{scalar}_max_s")
        lags[scalar] = Window(**w, nominal=round(w["nominal_s"] * f), low=round(w["min_s"] * f), high=round(w["max_s"] * f))
    return Config(s, reported, effective, convert, maps, round(minutes * 60 * K.MICROS), displacement, lags, tuple(warnings))


def _validate(c: Config) -> None:
    f, site, v = c.files, c.site, c.variables
    if not 1 <= f.header_line < f.first_data_line:
        raise ConfigError("files.header_line must be at least 1 and before files.first_data_line")
    if c.period.min_samples < 0:
        raise ConfigError("period.min_samples must not be negative")
    if abs(site.latitude) > 90:
        raise ConfigError("site.latitude must lie between -90 and 90")
    try:
        if not (c.output.float_format % 1.5).strip():
            raise ValueError
    except (TypeError, ValueError):
        raise ConfigError(f"output.float_format {c.output.float_format!r} doesn't format a number") from None
    for name in ("u", "v", "w", "ts"):
        if getattr(v, name) is None:
            raise ConfigError(f"variables.{name} is required")
    if (v.p_air is None) == (site.pressure_pa is None):
        raise ConfigError("declare exactly one source of pressure: variables.p_air or site.pressure_pa (blank the other)")
    if site.pressure_pa is not None and site.pressure_pa <= 0:
        raise ConfigError("site.pressure_pa must be positive")
    if c.despike.q <= 0:
        raise ConfigError("despike.q must be positive")
    for section, names in (("despike.variables", c.despike.variables), ("lag.scalars", c.lag.scalars), ("detrend.variables", c.detrend.variables), ("qc.steady_state_pair", c.qc.steady_state_pair)):
        allowed = [n for n in SERIES if n not in CELL]
        for n in names:
            if n not in allowed:
                raise ConfigError(f"{section} has {n!r}; known are {', '.join(allowed)}")
        if section != "qc.steady_state_pair" and len(set(names)) != len(names):
            raise ConfigError(f"{section} repeats a name")
    for n in c.detrend.variables:
        if n in ("ta", "p_air"):
            raise ConfigError(f"detrend.variables can't hold {n}: its mean is a state, not a fluctuation")
    if len(c.qc.steady_state_pair) != 2:
        raise ConfigError("qc.steady_state_pair is two names")
    if c.convert_cell and (v.t_cell is None or v.p_cell is None):
        raise ConfigError("closed-path densities need variables.t_cell and variables.p_cell")
    if c.spectral.enabled:
        for gas in GASES:
            tau = getattr(c.spectral, f"{gas}_tau_s")
            if tau is None or tau <= 0:
                raise ConfigError(f"spectral.{gas}_tau_s must be positive when spectral.enabled is true")


def describe(c: Config) -> str:
    """``section.key = value`` lines, derived values after the declared ones."""
    out = [f"{s}.{k} = {getattr(ns, k)}" for s, ns in c.sections.items() for k in KEYS[s]]
    out += [f"lag.{s}_{k} = {w}" for s, ws in c.lag.windows.items() for k, w in ws.items()]
    out += [f"derived.{g}_effective_measure_type = {c.effective[g]}" for g in GASES]
    out += [f"derived.convert_cell = {','.join(c.convert_cell)}", f"derived.displacement = {c.displacement}", f"derived.window_us = {c.window_us}"]
    out += [f"derived.{s}_lag_samples = {w.low}..{w.high}, nominal {w.nominal}" for s, w in c.lags.items()]
    return "\n".join(out)
