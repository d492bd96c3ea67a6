"""Where records are kept: the persistent store, and changelogs read from other tables."""
