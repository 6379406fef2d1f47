"""Sources and sinks: split CSV datasets, run-log trees and tables, metric and
quarantine sinks; every output path is below ``spark.checkpoint.dir``."""
