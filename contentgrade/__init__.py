"""Page quality at scale: tables of fetched pages to text, metrics, scores and reports."""
