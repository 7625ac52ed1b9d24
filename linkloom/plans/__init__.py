"""Plans that join several operators into runs."""
