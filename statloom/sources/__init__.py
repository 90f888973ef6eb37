from statloom.sources.tables import Tables, rename_clean, scan_csv, sink_csv

__all__ = ["Tables", "rename_clean", "scan_csv", "sink_csv"]
