"""Sources: folders, archives and documents."""
