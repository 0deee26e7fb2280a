"""Assembly parameters and their INI file."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

_LINE = re.compile(r"\s*([^=:]+?)\s*[=:]\s*(.*)")


def parse_int(text: str) -> int:
    """The leading integer, decimal, 0x or octal with a leading 0; 0 if there is none."""
    m = re.match(r"\s*([+-]?)(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9]\d*)", text)
    if not m:
        return 0
    digits = m[2]
    base = 16 if digits[:2].lower() == "0x" else 8 if digits[0] == "0" else 10
    return int(digits, base) * (-1 if m[1] == "-" else 1)


def read_ini(text: str) -> dict[str, str]:
    """section:key -> value with names in lower case; ; and # end a value, quotes around it go, lines may end in a backslash."""
    if text and not text.endswith("\n"):
        raise ValueError("the last line has no line end")
    out, section = {}, ""
    for line in text.replace("\\\n", "").splitlines():
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and "]" in line:
            section = line[1 : line.index("]")].strip().lower()
        elif m := _LINE.match(line):
            value = m[2]
            if value[:1] in "\"'" and value[:1] and value.find(value[0], 1) > 0:
                value = value[1 : value.find(value[0], 1)]
            else:
                value = re.split("[;#]", value)[0].strip()
            out[f"{section}:{m[1].lower()}"] = value
    return out


def write_ini(values: dict[str, str]) -> str:
    sections: dict[str, list[str]] = {}
    for name, value in values.items():
        section, _, key = name.partition(":")
        sections.setdefault(section, []).append(f"{key} = {value}\n")
    return "".join(f"[{s}]\n{''.join(lines)}\n" for s, lines in sections.items())


#: The keys of paths in a configuration, and the tables of an Assembly that each one keeps.
PATHS = {
    "HDFS_INPUT_PATH": ("reads",),
    "DeBruijn_PATH": ("kplus", "vertices"),
    "KmerLink_PATH": ("ranks",),
    "AmbVtx_PATH": ("ambiguous",),
    "NoBubble_PATH": ("contigs",),
    "Contig_PATH": ("filtered",),
    "AmbConnect_PATH": ("graph",),
    "NoTip_PATH": ("pruned_graph", "pruned_states"),
    "AmbLink_PATH": ("groups",),
    "HDFS_OUTPUT_PATH": ("sequences",),
}


def load_paths(text: str, section: str) -> dict[str, str]:
    """The paths that a configuration gives, by their keys as spelled in PATHS."""
    values = read_ini(text)
    return {key: path for key in PATHS if (path := values.get(f"{section.lower()}:{key.lower()}"))}


def only_section(text: str) -> str:
    """The section of a configuration that has one."""
    sections = {name.partition(":")[0] for name in read_ini(text)}
    if len(sections) != 1:
        raise ValueError(f"name one of the sections {sorted(sections)}")
    return sections.pop()


@dataclass(frozen=True)
class Parameters:
    """k-mer length, least count of a (k+1)-mer, edit distance of bubbles, tip length, and length that output must exceed."""

    k_mer_t: int = 4
    freq_t: int = 1
    bubble_t: int = 1
    tip_t: int = 1
    output_contig_t: int = 10

    @classmethod
    def load(cls, text: str, section: str) -> Parameters:
        values = read_ini(text)
        found = {f.name: parse_int(values[key]) for f in fields(cls) if (key := f"{section.lower()}:{f.name}") in values}
        return cls(**found)
