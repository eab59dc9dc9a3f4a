"""Plans: what should be done, as tables; nothing here touches files."""
