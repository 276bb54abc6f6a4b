"""Column expressions: functions from Column to Column, no shuffles."""
