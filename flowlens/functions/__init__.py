"""Column expressions, cursors and calendars."""
