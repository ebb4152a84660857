"""Table scans, sinks and the views that stand in for the study's private tables."""
