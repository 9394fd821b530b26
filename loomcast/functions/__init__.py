"""Column functions: bases, calendars, trees."""
