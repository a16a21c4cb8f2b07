"""DataFrame operators over hourly grid activity."""
