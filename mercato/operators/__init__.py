"""One function per analytic statement; see README for the key list."""
