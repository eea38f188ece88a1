"""Writers: append, routed, quarantine, reports, archive, live mirror."""
