"""Record operators as DataFrame plans: sorting, merging, searching, keyed verbs, control breaks, record stores."""
