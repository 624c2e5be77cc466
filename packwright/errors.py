"""Errors that stop a job before it changes anything a reader can see."""


class MaintenanceError(RuntimeError):
    """The job was refused or stopped; the live data is as it was."""


class InventoryError(MaintenanceError):
    """The listing is empty, has files outside any table, or changed while the job ran."""


class LateFileError(InventoryError):
    """A file came during the swap. The old tree is live again; the copy stays at `<base>_bkup`."""


class VerificationError(MaintenanceError):
    """The rewritten rows are not the same multiset as the original rows."""


class PromotionError(MaintenanceError):
    """A swap could not be made, or was undone."""


class BrokenSwapError(RuntimeError):
    """A swap failed and could not be undone: nothing was deleted, the message says what lies where."""


class ReplacementError(RuntimeError):
    """A load failed after it began to replace the old rows: they may be gone. The message says where the decoded
    rows are."""
