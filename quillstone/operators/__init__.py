"""The table jobs: functions from DataFrame to DataFrame."""
