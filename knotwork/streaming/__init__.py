"""No operator here: discovery is over bounded tables, as any new row can end a dependency."""
