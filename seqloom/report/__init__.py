"""Writers of a run's reports: text, summary, JSON, HTML with SVG figures, and a ZIP of them all."""
