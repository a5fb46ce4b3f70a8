"""SVG figures of modules: lines, box plots and a heat map."""

from __future__ import annotations

import html
import math

from ..plans.qc import Module

WIDTH, HEIGHT, LEFT, BOTTOM, TOP = 800, 600, 60, 60, 40
PALETTE = ["#c00000", "#0000c0", "#008000", "#202020", "#c000c0", "#606060", "#c0c000", "#00a0a0"]
MOST_LABELS = 50


def _frame(title: str, labels: list[str], lo: float, hi: float, body: str) -> str:
    e = html.escape
    step = max(1, -(-len(labels) // MOST_LABELS))
    wide = (WIDTH - LEFT - 20) / max(len(labels), 1)
    ticks = []
    for i in range(6):
        v = lo + (hi - lo) * i / 5
        y = _y(v, lo, hi)
        ticks.append(
            f"<line x1='{LEFT}' x2='{WIDTH - 20}' y1='{y:.1f}' y2='{y:.1f}' stroke='#ddd'/><text x='{LEFT - 5}' y='{y + 4:.1f}' text-anchor='end' font-size='10'>{v:.4g}</text>"
        )
    names = "".join(
        f"<text x='{LEFT + wide * (i + 0.5):.1f}' y='{HEIGHT - BOTTOM + 14}' text-anchor='middle' font-size='8'>{e(t)}</text>" for i,
        t in enumerate(labels) if i % step == 0
    )
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{WIDTH}' height='{HEIGHT}'><rect width='100%' height='100%' fill='white'/><text x='{WIDTH / 2}' y='20' text-anchor='middle' font-size='14'>{e(title)}</text>{''.join(ticks)}{names}{body}</svg>"


def _y(v: float, lo: float, hi: float) -> float:
    return HEIGHT - BOTTOM - (v - lo) / ((hi - lo) or 1) * (HEIGHT - BOTTOM - TOP)


def lines(title: str, labels: list[str], series: list[tuple[str, list[float]]], lo: float = 0.0, hi: float | None = None) -> str:
    hi = hi if hi is not None else max([1e-9, *(v for _, vs in series for v in vs)])
    wide = (WIDTH - LEFT - 20) / max(len(labels), 1)
    body = []
    for k, (name, values) in enumerate(series):
        colour = PALETTE[k % len(PALETTE)]
        points = " ".join(f"{LEFT + wide * (i + 0.5):.1f},{_y(v, lo, hi):.1f}" for i, v in enumerate(values))
        body.append(
            f"<polyline points='{points}' fill='none' stroke='{colour}' stroke-width='2'/><text x='{WIDTH - 25}' y='{TOP + 14 * k + 10}' text-anchor='end' font-size='11' fill='{colour}'>{html.escape(name)}</text>"
        )
    return _frame(title, labels, lo, hi, "".join(body))


def boxes(title: str, rows: list[tuple]) -> str:
    """Rows of label, mean, median, lower and upper quartile, 10th and 90th percentile; on bands of bad, fair and good."""
    labels = [r[0] for r in rows]
    hi = max([40.0, *(v for r in rows for v in r[1:] if not math.isnan(v))])
    wide = (WIDTH - LEFT - 20) / max(len(rows), 1)
    body = "".join(
        f"<rect x='{LEFT}' y='{_y(b, 0, hi):.1f}' width='{WIDTH - LEFT - 20}' height='{_y(a, 0, hi) - _y(b, 0, hi):.1f}' fill='{c}'/>" for a,
        b, c in ((0, 20, "#f4cccc"), (20, 28, "#fce8cc"), (28, hi, "#d6efd6"))
    )
    for i, (_, _, median, lower, upper, p10, p90) in enumerate(rows):
        if math.isnan(median):
            continue
        x = LEFT + wide * (i + 0.5)
        y = {k: _y(v, 0, hi) for k, v in (("m", median), ("l", lower), ("u", upper), ("a", p10), ("b", p90))}
        body += f"<line x1='{x:.1f}' x2='{x:.1f}' y1='{y['a']:.1f}' y2='{y['b']:.1f}' stroke='black'/><rect x='{x - wide * 0.4:.1f}' y='{y['u']:.1f}' width='{wide * 0.8:.1f}' height='{max(0.5, y['l'] - y['u']):.1f}' fill='#f0f000' stroke='black' stroke-width='0.5'/><line x1='{x - wide * 0.4:.1f}' x2='{x + wide * 0.4:.1f}' y1='{y['m']:.1f}' y2='{y['m']:.1f}' stroke='#c00000'/>"
    body += f"<polyline fill='none' stroke='#0000c0' points='{' '.join(f'{LEFT + wide * (i + 0.5):.1f},{_y(r[1], 0, hi):.1f}' for i, r in enumerate(rows))}'/>"
    return _frame(title, labels, 0, hi, body)


def shade(share: float) -> str:
    """From blue over green to red; the square root spreads small values."""
    s = math.sqrt(min(max(share, 0.0), 1.0))
    a, b = (min(1.0, 2 * s), max(0.0, 2 * s - 1))
    return f"#{int(255 * b):02x}{int(255 * (a - b)):02x}{int(255 * (1 - a)):02x}"


def heat(title: str, labels: list[str], tiles: list[dict], worst: float) -> str:
    wide, high = (WIDTH - LEFT - 20) / max(len(labels), 1), (HEIGHT - BOTTOM - TOP) / max(len(tiles), 1)
    body = "".join(
        f"<rect x='{LEFT + wide * j:.1f}' y='{TOP + high * i:.1f}' width='{wide:.2f}' height='{high:.2f}' fill='{shade(-v / (worst or 1))}'/>" for i,
        t in enumerate(tiles) for j, v in enumerate(t["mean_deviation"])
    )
    return _frame(title, labels, 0, max(len(tiles), 1), body)


def icon(status: str) -> str:
    colour = {"pass": "#080", "warn": "#c80", "fail": "#c00"}[status]
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='24' height='24'><circle cx='12' cy='12' r='10' fill='{colour}'/></svg>"


def figure(m: Module) -> str | None:
    """A module's figure; none for tables."""
    if not m.rows:
        return None
    labels = [str(r[0]) for r in m.rows]
    match m.id:
        case "kmer_content":
            series = [(x["sequence"], x["obs_exp"]) for x in m.data["plot_series"]]
            return lines("Observed to expected k-mers by position", m.data["position_groups"], series, 0, max((v for _, x in series for v in x), default=1.0))
        case "per_base_sequence_quality":
            return boxes("Quality scores across all bases", m.rows)
        case "per_tile_sequence_quality":
            return heat("Quality per tile", m.data["position_groups"], m.data["tiles"], m.data["max_deviation"])
        case "per_sequence_quality_scores":
            return lines("Quality score distribution over all sequences", labels, [("Average Quality per read", [r[1] for r in m.rows])])
        case "per_base_sequence_content":
            return lines("Sequence content across all bases", labels, [(f"%{b}", [r[k + 1] for r in m.rows]) for k, b in enumerate("GATC")], 0, 100)
        case "per_sequence_gc_content":
            return lines(
                "GC distribution over all sequences", labels,
                [
                    ("GC count per read", [r[1] for r in m.rows]),
                    ("Theoretical Distribution", [d["theoretical_count"] for d in m.data["distribution"]])
                ]
            )
        case "per_base_n_content":
            return lines("N content across all bases", labels, [("%N", [r[1] for r in m.rows])], 0, 100)
        case "sequence_length_distribution":
            return lines("Distribution of sequence lengths over all sequences", labels, [("Sequence Length", [r[1] for r in m.rows])])
        case "sequence_duplication_levels":
            return lines("Percent of sequences by duplication level", labels, [("% Total sequences", [r[1] for r in m.rows])], 0, 100)
        case "adapter_content":
            return lines("% Adapter", labels, [(s["adapter_name"], s["values"]) for s in m.data["series"]], 0, 100)
    return None
