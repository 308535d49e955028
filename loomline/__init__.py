"""Program facts as DataFrames: scans, joins, graphs, data flow and findings on Spark."""
