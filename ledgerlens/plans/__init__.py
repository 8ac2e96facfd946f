"""The reports: functions from domain tables and dates to a DataFrame."""
