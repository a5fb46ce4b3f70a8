"""Reports of one file, from its modules' tables."""

from __future__ import annotations

import base64
import html
import io
import json
import zipfile
from datetime import datetime, timezone
from pathlib import Path

from .. import __version__
from ..functions.kernels import number_text, plain_number
from ..plans.qc import FileReport, Module
from . import figures

TOOL = "seqloom"
# The endings that an output's name loses, in this order, each once.
ENDINGS = [".gz", ".bz2", ".txt", ".fastq", ".fq", ".csfastq", ".sam", ".bam", ".ubam"]
STATUS_WORDS = {"pass": "PASS", "warn": "WARN", "fail": "FAIL"}


def output_base(name: str) -> str:
    for ending in ENDINGS:
        name = name.removesuffix(ending)
    return name


def cell(value: object, module: Module) -> str:
    if isinstance(value, float):
        return plain_number(value) if module.id == "kmer_content" else number_text(value)
    return str(value)


def text_report(report: FileReport, tool: str = TOOL, version: str = __version__) -> str:
    lines = [f"##{tool}\t{version}"]
    for m in report.modules:
        if not m.reported:
            continue
        lines.append(f">>{m.name}\t{m.status}")
        if m.header:
            head = m.header
            if m.id == "sequence_duplication_levels":
                first, _, rest = head.partition("\n")
                head = f"{first.partition(chr(9))[0]}\t{number_text(m.data['deduplicated_percentage'])}\n{rest}"
            lines.append(head)
        lines += ["\t".join(cell(v, m) for v in row) for row in m.rows]
        lines.append(">>END_MODULE")
    return "\n".join(lines) + "\n"


def summary(report: FileReport) -> str:
    return "".join(f"{STATUS_WORDS[m.status]}\t{m.name}\t{report.file_name}\n" for m in report.modules if m.reported)


def json_report(report: FileReport, now: datetime | None = None) -> dict:
    counts = {s: sum(m.status == s for m in report.modules) for s in ("pass", "warn", "fail", "not_applicable")}
    b = report.modules[0].data
    modules = []
    for m in report.modules:
        entry = {
            "id": m.id, "name": m.name, "description": m.description, "status": m.status,
            "in_report": m.reported, "omitted_reason": None if m.reported else "module ignored"
        }
        if m.thresholds is not None:
            entry["thresholds"] = m.thresholds
        modules.append(entry | {"data": m.data})
    return {
        "schema_version": "1.0.0",
        "generated_by": {"tool": TOOL, "version": __version__},
        "generated_at": (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "input": {"file_name": report.file_name, "source_path": report.source_path, "detected_format": report.format},
        "summary": {
            "overall_status": report.overall(),
            "module_counts": counts,
            "basic_statistics": {
                "total_sequences": b["total_sequences"], "filtered_sequences": b["filtered_sequences"],
                "total_bases": b["total_bases"], "min_sequence_length": b["sequence_length"]["min"],
                "max_sequence_length": b["sequence_length"]["max"], "gc_percent": b["gc_percent"]
            },
        },
        "modules": modules,
    }


def html_report(report: FileReport) -> str:
    e = html.escape
    parts = [
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(report.file_name)}</title><style>body{{font-family:sans-serif;margin:1em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px}}.pass{{color:#080}}.warn{{color:#c80}}.fail{{color:#c00}}</style></head><body><h1>{e(report.file_name)}</h1><h2>Summary</h2><ul>"
    ]
    shown = [m for m in report.modules if m.reported]
    parts += [f"<li class='{m.status}'>[{STATUS_WORDS[m.status]}] <a href='#M{i}'>{e(m.name)}</a></li>" for i, m in enumerate(shown)]
    parts.append("</ul>")
    for i, m in enumerate(shown):
        parts.append(f"<h2 id='M{i}' class='{m.status}'>{e(m.name)}</h2>")
        if svg := figures.figure(m):
            parts.append(f"<img alt='{e(m.name)}' src='data:image/svg+xml;base64,{base64.b64encode(svg.encode()).decode()}'>")
        if not m.rows:
            parts.append(f"<p>No {e(m.name.lower())}</p>")
            continue
        # what a figure shows is there as a table, too, folded up
        folded = m.id not in ("basic_statistics", "overrepresented_sequences", "kmer_content")
        head = m.header.split("\n")[-1].lstrip("#").split("\t")
        parts.append(
            (
                "<details><summary>Values</summary>" if folded else ""
            ) + "<table><thead><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr></thead><tbody>"
        )
        parts += ["<tr>" + "".join(f"<td>{e(plain_number(v) if isinstance(v, float) else str(v))}</td>" for v in row) + "</tr>" for row in m.rows]
        parts.append("</tbody></table>" + ("</details>" if folded else ""))
    parts.append("</body></html>")
    return "".join(parts)


def write_all(
    report: FileReport, folder: str | Path, suffix: str = "_qc", extract: bool = False,
    delete_zip: bool = False, as_json: bool = False
) -> list[Path]:
    """The HTML and the ZIP (a folder with report, data, summary and images), and what else is asked for."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    base = output_base(report.file_name) + suffix
    files = {"report.html": html_report(report), "qc_data.txt": text_report(report), "summary.txt": summary(report)}
    files |= {f"Images/{m.id}.svg": svg for m in report.modules if m.reported and (svg := figures.figure(m))}
    files |= {f"Icons/{s}.svg": figures.icon(s) for s in STATUS_WORDS}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(f"{base}/{name}", text)
    made = [folder / f"{base}.html", folder / f"{base}.zip"]
    made[0].write_text(files["report.html"])
    made[1].write_bytes(packed.getvalue())
    if extract:
        with zipfile.ZipFile(made[1]) as z:
            z.extractall(folder)
        if delete_zip:
            made.pop().unlink()
    if as_json:
        made.append(folder / f"{base}.json")
        made[-1].write_text(json.dumps(json_report(report), indent=2))
    return made
