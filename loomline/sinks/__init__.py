"""Results as text, JSON, SARIF, DOT, GraphML, CSV and a bill of materials."""
