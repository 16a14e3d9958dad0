"""Unit expressions: a grammar, dimensions as exponent vectors, exact scale and offset to canonical units.

    list     := entry (separator entry)*          one unit after the last number holds for the numbers before it
    entry    := number [unit]
    unit     := product (('/' | 'per') product)*
    product  := power (('*' | '.' | blank) power)*
    power    := atom ['^' integer]
    atom     := [prefix] symbol | '(' unit ')'

A unit is (scale, offset, exponents): canonical = number * scale + offset, in SI base units and ``bit``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

#: Order of the exponents.
BASE = ("m", "kg", "s", "A", "K", "mol", "cd", "bit")

# SI prefixes (by symbol, by name) and units as (scale, offset, exponents by base).
PREFIX_SYMBOLS = {"T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "d": -1, "c": -2, "m": -3, "u": -6, "µ": -6, "μ": -6, "n": -9, "p": -12, "f": -15}
PREFIX_NAMES = {"tera": 12, "giga": 9, "mega": 6, "kilo": 3, "hecto": 2, "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9, "pico": -12, "femto": -15}
SYMBOLS = {
    "m": (1, 0, {"m": 1}), "g": (Fraction(1, 1000), 0, {"kg": 1}), "s": (1, 0, {"s": 1}), "A": (1, 0, {"A": 1}), "K": (1, 0, {"K": 1}),
    "mol": (1, 0, {"mol": 1}), "cd": (1, 0, {"cd": 1}), "Hz": (1, 0, {"s": -1}), "N": (1, 0, {"kg": 1, "m": 1, "s": -2}),
    "Pa": (1, 0, {"kg": 1, "m": -1, "s": -2}), "J": (1, 0, {"kg": 1, "m": 2, "s": -2}), "W": (1, 0, {"kg": 1, "m": 2, "s": -3}),
    "C": (1, 0, {"A": 1, "s": 1}), "V": (1, 0, {"kg": 1, "m": 2, "s": -3, "A": -1}), "Ohm": (1, 0, {"kg": 1, "m": 2, "s": -3, "A": -2}),
    "Ω": (1, 0, {"kg": 1, "m": 2, "s": -3, "A": -2}), "F": (1, 0, {"A": 2, "s": 4, "kg": -1, "m": -2}), "T": (1, 0, {"kg": 1, "s": -2, "A": -1}),
    "min": (60, 0, {"s": 1}), "h": (3600, 0, {"s": 1}), "L": (Fraction(1, 1000), 0, {"m": 3}),
    "degC": (1, Fraction(27315, 100), {"K": 1}), "°C": (1, Fraction(27315, 100), {"K": 1}),
    "degF": (Fraction(5, 9), Fraction(45967, 180), {"K": 1}), "°F": (Fraction(5, 9), Fraction(45967, 180), {"K": 1}),
    "in": (Fraction(254, 10000), 0, {"m": 1}), "ft": (Fraction(3048, 10000), 0, {"m": 1}), "bit": (1, 0, {"bit": 1}), "count": (1, 0, {"bit": 1}),
    "%": (Fraction(1, 100), 0, {}),
}
NAMES = {
    "metre": "m", "meter": "m", "gram": "g", "second": "s", "sec": "s", "ampere": "A", "amp": "A", "kelvin": "K", "mole": "mol", "candela": "cd",
    "hertz": "Hz", "newton": "N", "pascal": "Pa", "joule": "J", "watt": "W", "coulomb": "C", "volt": "V", "ohm": "Ohm", "farad": "F", "tesla": "T",
    "minute": "min", "hour": "h", "litre": "L", "liter": "L", "celsius": "degC", "fahrenheit": "degF", "inch": "in", "foot": "ft", "feet": "ft",
    "bit": "bit", "count": "count", "percent": "%",
}
NO_PREFIX = {"min", "h", "degC", "°C", "degF", "°F", "in", "ft", "%", "bit", "count"}


@dataclass(frozen=True)
class Unit:
    scale: Fraction
    offset: Fraction
    exponents: tuple[int, ...]


class UnitError(ValueError):
    pass


def _vector(powers: dict[str, int]) -> tuple[int, ...]:
    return tuple(powers.get(b, 0) for b in BASE)


def _atom(word: str) -> Unit:
    def known(symbol: str, power: int) -> Unit:
        scale, offset, powers = SYMBOLS[symbol]
        return Unit(Fraction(scale) * Fraction(10) ** power, Fraction(offset), _vector(powers))

    if word in SYMBOLS:
        return known(word, 0)
    low = word.lower()
    for name in (low, low[:-1] if low.endswith("s") else low):
        if name in NAMES:
            return known(NAMES[name], 0)
        for prefix, power in PREFIX_NAMES.items():
            if name.startswith(prefix) and name[len(prefix) :] in NAMES:
                return known(NAMES[name[len(prefix) :]], power)
    for n in (1, 2):
        prefix, rest = word[:n], word[n:]
        if prefix in PREFIX_SYMBOLS and rest in SYMBOLS and rest not in NO_PREFIX:
            return known(rest, PREFIX_SYMBOLS[prefix])
    if low in ("mv", "uv", "µv", "μv", "nv", "pv", "kv", "v"):
        return known("V", PREFIX_SYMBOLS[low[0]] if len(low) == 2 else 0)
    raise UnitError(f"unknown unit {word!r}")


_TOKEN = re.compile(r"\s*(?:(per\b)|([A-Za-zµμΩ°%]+)|([-+]?\d+)|([*·./^()])|(⁻?[¹²³]))")
_RAISED = {"¹": 1, "²": 2, "³": 3, "⁻¹": -1, "⁻²": -2, "⁻³": -3}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise UnitError(f"cannot read unit {text!r}")
        per, word, number, sign, raised = m.groups()
        out.append(("op", "/") if per else ("word", word) if word else ("int", number) if number else ("op", sign) if sign else ("raised", raised))
        at = m.end()
    return out


@lru_cache(maxsize=4096)
def parse_unit(text: str) -> Unit:
    """Parse a unit expression; raises UnitError for anything else."""
    tokens, at = _tokens(text), 0
    if not tokens:
        raise UnitError("empty unit")

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def combine(a: Unit, b: Unit, sign: int) -> Unit:
        return Unit(a.scale * b.scale**sign, Fraction(0), tuple(x + sign * y for x, y in zip(a.exponents, b.exponents)))

    def unit() -> Unit:
        nonlocal at
        left = product()
        while peek() == ("op", "/"):
            at += 1
            left = combine(left, product(), -1)
        return left

    def product() -> Unit:
        nonlocal at
        left = power()
        while peek()[0] == "word" or peek() in (("op", "*"), ("op", "·"), ("op", "."), ("op", "(")):
            if peek()[0] == "op" and peek()[1] != "(":
                at += 1
            left = combine(left, power(), 1)
        return left

    def power() -> Unit:
        nonlocal at
        kind, value = peek()
        at += 1
        if kind == "word":
            base = _atom(value)
        elif (kind, value) == ("op", "("):
            base = unit()
            if peek() != ("op", ")"):
                raise UnitError(f"missing ) in {text!r}")
            at += 1
        else:
            raise UnitError(f"cannot read unit {text!r}")
        exponent = None
        if peek()[0] == "raised":
            exponent, at = _RAISED[peek()[1]], at + 1
        elif peek() == ("op", "^"):
            at += 1
            if peek()[0] != "int":
                raise UnitError(f"bad exponent in {text!r}")
            exponent, at = int(peek()[1]), at + 1
        if exponent is None:
            return base
        if abs(exponent) > 20:
            raise UnitError(f"bad exponent in {text!r}")
        return Unit(base.scale**exponent, Fraction(0), tuple(x * exponent for x in base.exponents))

    result = unit()
    if at != len(tokens):
        raise UnitError(f"cannot read unit {text!r}")
    return result


def compatible(a: Unit, b: Unit, implied: str = "bit") -> bool:
    """Same dimension; a missing exponent of ``implied`` (volts written for volts per bit) is filled in."""
    i = BASE.index(implied)
    return all(x == y for k, (x, y) in enumerate(zip(a.exponents, b.exponents)) if k != i) and (a.exponents[i] == b.exponents[i] or 0 in (a.exponents[i], b.exponents[i]))


def convert(number: Fraction, unit: str, target: str) -> Fraction | None:
    """number of unit, in target; null where the dimensions differ or a unit can't be read."""
    try:
        a, b = parse_unit(unit), parse_unit(target)
    except UnitError:
        return None
    return (number * a.scale + a.offset - b.offset) / b.scale if compatible(a, b) else None


_NUMBER = re.compile(r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?")


def parse_quantities(text: str | None) -> list[tuple[Fraction | None, str | None]]:
    """The entries of a list as (number, unit text); an entry that can't be read keeps its place as (None, None)."""
    if text is None or not text.strip("\0 \t\r\n"):
        return []
    out: list[list] = []
    for part in text.strip("\0 \t\r\n;").split(";"):
        part, at, began = part.strip(), 0, len(out)
        while at < len(part):
            rest = part[at:]
            if rest[0].isspace():
                at += 1
                continue
            m = _NUMBER.match(rest)
            if m and len(m.group()) < 80:
                whole, _, exponent = m.group().lower().partition("e")
                if abs(int(exponent or 0)) > 60:
                    out.append([None, None])
                else:
                    out.append([Fraction(whole.replace(",", ".").rstrip(".")) * Fraction(10) ** int(exponent or 0), None])
                at += m.end()
                continue
            words = re.match(r"[^\d\s;][^\s;]*(?:\s+per\s+[^\s\d;]+)?", rest)
            word = words.group() if words else rest
            try:
                parse_unit(word)
                for entry in out[began:]:
                    entry[1] = entry[1] or word
                if len(out) == began:
                    out.append([None, None])
            except UnitError:
                out.append([None, None])
            at += len(word)
    units = [u for _, u in out if u]
    if out and units and out[-1][1]:  # a unit once, at the end of the whole list
        for entry in out:
            entry[1] = entry[1] or out[-1][1]
    return [(n, u) for n, u in out]
